"""Problems of many shapes, one kind after another, for what plain products and differences never reach.

All signs, decimals, quotients as results, results that are no number, phantom
and fractional leaves, conversions, backward chains, texts without steps or
answer.  The numbers of a problem lie in ranges that don't meet (x from 201, y
from 301, z from 21), so no two of its values agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.sources.domain import table

#: Question and solution of each kind; ``{e}`` of a name stands for its value, names are those of :data:`VALUES`.
KINDS = [
    ("A hall has {x} seats, {y} chairs and {z} stools. How many?", "<<{x}+{y}={x+y}>> <<{x+y}+{z}={x+y+z}>>\n#### {x+y+z}"),
    ("A hall has {x} rows of {y} seats; {z} are broken. How many work?", "<<{x}*{y}={x*y}>> <<{x*y}-{z}={x*y-z}>>\n#### {x*y-z}"),
    ("A pond of {x*y} fish is shared by {y} herons. How many each?", "<<{x*y}/{y}={x}>> <<{x}+{z}={x+z}>>\n#### {x+z}"),  # z is a phantom leaf
    ("A cart costs 1.5 for each of {x} hours. How much?", "<<{x}*1.5={x*1.5}>> <<{x*1.5}+{z}={x*1.5+z}>>\n#### {x*1.5+z}"),  # a fractional leaf
    ("Eggs come 12 in a dozen and there are 2 dozen. How many?", "<<12*2=24>> <<24+2=26>>\n#### 26"),  # nothing may change
    ("A box has {x} pens. {y} come and are taken again, {z} stay?", "<<{x}+{y}={x+y}>> <<{x+y}-{y}={x}>> <<{x}+{z}={x+z}>>\n#### {x+z}"),  # a backward chain
    ("{x} modulo {z} is what?", "<<{x}%{z}={x%z}>>\n#### {x%z}"),
    ("{z} less {x} is what?", "<<{z}-{x}={z-x}>>\n#### {z-x}"),
    ("{x} words, no sums?", "It is {x}.\n#### {x}"),
    ("{x} and {y}, no answer?", "<<{x}+{y}={x+y}>>"),
    ("Just {x}?", "<<{x}={x}>>\n#### {x}"),
    ("{x} pairs make how many of {y}?", "<<{x}*{y}={2*x*y}/2>> <<{2*x*y}/2={x*y}>>\n#### {x*y}"),  # a quotient as a result, and two as a hidden leaf
    ("{x} of {y}?", "<<{x}*{y}=many>> <<{y}-{x}={y-x}>>\n#### {y-x}"),  # a result that is no number
    ("{x} plus {y} is not what?", "<<{x}+{y}={x+y}>> <<{x}+{z}={x+z}>>\n#### {y}"),  # the answer differs
    ("{x} metres and {y}, halved {z} ways?", "<<({x}+{y})*2={2*x+2*y}>> <<{y}/2={y/2}>>\n#### {y/2}"),  # mixed signs
]
#: The values that texts show: as a Spark expression, and as text in SQL; decimals lose zeros at their end.
VALUES = ["x", "y", "z", "x+y", "x+y+z", "x*y", "x*y-z", "x+z", "x*1.5", "x*1.5+z", "x%z", "z-x", "2*x*y", "y-x", "2*x+2*y", "y/2"]
#: Those with a half.
HALVES = {"x*1.5": "3*x", "x*1.5+z": "3*x+2*z", "y/2": "y"}
_X, _Y, _Z = "200 + CAST(l_quantity AS BIGINT)", "300 + p_size", "20 + l_linenumber"


def shown(value: str) -> str:
    """SQL for a value as text, in Spark's and in DuckDB's dialect alike."""
    if value in HALVES:
        twice = HALVES[value]
        return f"concat(CAST(CAST(floor(({twice}) / 2.0) AS BIGINT) AS STRING), CASE WHEN ({twice}) % 2 = 1 THEN '.5' ELSE '' END)"
    return f"CAST({value} AS STRING)"


def _template(text: str) -> str:
    """SQL that fills a template."""
    parts, rest = [], text.replace("'", "''")
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [f"'{before}'"] * bool(before) + [shown(name)]
    parts += [f"'{rest}'"] * bool(rest)
    return f"concat({', '.join(parts)})"


def _by_kind(at: int) -> str:
    whens = " ".join(f"WHEN {k} THEN {_template(kind[at])}" for k, kind in enumerate(KINDS))
    return f"CASE kind {whens} END"


ROWS = f"""SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS pid, (l_orderkey + l_suppkey) % {len(KINDS)} AS kind,
    {_X} AS x, {_Y} AS y, {_Z} AS z FROM lineitem JOIN part ON l_partkey = p_partkey"""
SQL = f"""WITH w AS ({ROWS.replace('STRING', 'VARCHAR').replace('CAST(l_quantity AS BIGINT)', 'CAST(trunc(l_quantity) AS BIGINT)')})"""


def wide_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, kind, x, y, z, question, solution``."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x, y, z = (200 + F.col("l_quantity").cast("bigint")), (300 + F.col("p_size").cast("bigint")), (20 + F.col("l_linenumber").cast("bigint"))
    pid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").cast("string"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(pid.alias("pid"), F.pmod(F.col("l_orderkey") + F.col("l_suppkey"), F.lit(len(KINDS))).alias("kind"), x.alias("x"), y.alias("y"), z.alias("z"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *rows.columns).distinct()
    return rows.withColumn("question", _filled(0)).withColumn("solution", _filled(1))


def _filled(at: int) -> Column:
    return F.expr(_by_kind(at).replace("\n", "\\n"))
