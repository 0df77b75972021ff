"""Extension points as SQL functions: parsers by name, and variants of an item by lateral join.

After :func:`register` a session knows ``parse_<name>(solution)`` for every
parser of :data:`PARSERS` and ``draw_variants(pid, nodes, free, answer, variants,
attempts)``, a table function that gives a row for each variant::

    SELECT p.pid, v.k, v.answer FROM problems p, LATERAL draw_variants(p.pid, p.nodes, p.free, p.answer, 2, 10) v

A table function is called row by row.  ``drawn_variants`` takes the same and
gives an item's variants as one array, many items at a time::

    SELECT pid, k, v.answer FROM problems LATERAL VIEW explode(array(drawn_variants(pid, nodes, free, answer, 2, 10))) d AS drawn
        LATERAL VIEW inline(drawn) v AS k, attempt, `values`, answer
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from probeframe.functions.graph_parser import parse_batch
from probeframe.functions.graphs import GRAPH

#: Parsers by name: from an Arrow array of solutions to one of graphs (``graphs.GRAPH``).
PARSERS: dict[str, Callable[[pa.Array], pa.Array]] = {"script": lambda texts: parse_batch(texts, False), "strict": lambda texts: parse_batch(texts, True)}


class DrawVariants:
    """The table function: the variants that ``variants.mutate`` draws for one item, ``k, attempt, values, answer``; none for null arguments."""

    def eval(self, pid: str, nodes: list, free: list, answer: float, variants: int, attempts: int) -> Iterator[tuple]:
        from probeframe.operators.variants import sampled

        if pid is None or nodes is None or free is None or answer is None or not variants:
            return
        plain = [n["op"] for n in nodes], [list(n["refs"]) for n in nodes], [float(n["value"]) for n in nodes]
        for k in range(variants):
            found = sampled(*plain, list(free), float(answer), f"{pid}|{k}", attempts or 0)
            if found:
                yield (k, *found)


def register(spark: SparkSession, parsers: dict[str, Callable[[pa.Array], pa.Array]] | None = None) -> None:
    """Makes the functions known to ``spark``; ``parsers`` adds some of one's own, or replaces known ones."""
    for name, parser in (PARSERS | (parsers or {})).items():
        spark.udf.register(f"parse_{name}", F.arrow_udf(_on_arrays(parser), GRAPH))
    spark.udf.register("drawn_variants", F.arrow_udf(_drawn, "array<struct<k:int,attempt:int,`values`:array<double>,answer:double>>"))
    spark.udtf.register("draw_variants", F.udtf(DrawVariants, returnType="k int, attempt int, `values` array<double>, answer double"))


def _drawn(pids, nodes, free, answers, variants, attempts):
    from probeframe.operators.draws import drawn_lists

    return drawn_lists(pids, nodes, free, answers, variants, attempts)


_drawn.__annotations__ = dict.fromkeys(["pids", "nodes", "free", "answers", "variants", "attempts", "return"], pa.Array)


def _on_arrays(parser: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The parser with the annotations by which Spark knows a function on Arrow arrays."""

    def read(solutions: pa.Array) -> pa.Array:
        return parser(solutions)

    read.__annotations__ = {"solutions": pa.Array, "return": pa.Array}
    return read
