"""Datasets and results as JSON files.

A dataset is one document with ``items``, each with its ``variants``, or lines of
items; results are a document for each model with ``raw_results`` by key.  Spark
reads files in parallel, a document of several lines by one task each; lines are
split.  All schemas are given, so no file is read to infer one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.operators.scratch import scratch_root
from probeframe.sources.result_log import ResultLog

QUESTION = "item_id string, question string, answer double, is_original boolean, status string, regenerated boolean, all_values_present boolean"
ITEM = f"{QUESTION}, variants array<struct<{', '.join(c.replace(' ', ':', 1) for c in QUESTION.split(', '))}>>"
RESULT = "struct<item_id:string,trial:int,is_original:boolean,extracted:double,expected:double,correct:boolean,response:string>"
RESULTS = f"model string, dataset string, temperature double, trials int, raw_results map<string,{RESULT}>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of datasets that are single documents; a document without a list of items raises ValueError.

    Fields that a file lacks are null; an empty list has no rows.
    """
    listed = ", ".join(c.replace(" ", ":", 1) for c in ITEM.split(", variants ")[0].split(", ")) + ", variants:" + ITEM.split(", variants ")[1]
    if _laid_out(spark, path, "items"):
        # each item begins and ends on lines of its own, and no JSON text holds a raw line end: items are found wherever a file is split
        pieces = spark.read.option("lineSep", BETWEEN).text(path).select(F.element_at(F.split("value", OPENED, 2), -1).alias("value"))
        whole = F.when(F.contains("value", F.lit("\n  ],")), F.raise_error(F.lit("something follows the list of items"))).otherwise(F.regexp_replace("value", r"\n    \}\n  \]\n\}\s*\z", ""))
        return pieces.select(F.from_json(F.concat(F.lit("{"), whole, F.lit("}")), ITEM).alias("item")).select("item.*")
    files = spark.read.schema(f"items array<struct<{listed}>>").option("multiLine", True).json(path)
    bad = files.filter("items is null").select(F.input_file_name().alias("file")).first()
    if bad:
        raise ValueError(f"{bad['file']} has no list of items")
    return files.select(F.inline("items"))


#: What stands between two items of a document that :func:`write_document` lays out, and what opens their list.
BETWEEN, OPENED = "\n    },\n    {", r'\n  "items": \[\n    \{'
#: Bytes of a file's head in which its list must open.
HEAD = 1 << 16


def _laid_out(spark: SparkSession, path: str, name: str) -> bool:
    """Whether every file of ``path`` has the layout of :func:`write_document` with two spaces: objects of a list ``name`` that ends the document.  Reads the files' ends only."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in (fs.globStatus(target) or [])]
    if not found or not all(s.isFile() for s in found):
        return False
    for s in found:
        head, tail = _ends(jvm, fs, s)
        before, opened, _ = head.partition(f'\n  "{name}": [\n    {{')
        if not opened or BETWEEN in before or not tail.rstrip().endswith("\n    }\n  ]\n}"):
            return False
    return True


def _ends(jvm, fs, status) -> tuple[str, str]:
    """A file's head and tail as texts."""
    file = fs.open(status.getPath())
    try:
        read = lambda at, n: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(_at(file, at), n)).decode("utf-8", "replace")
        return read(0, min(HEAD, status.getLen())), read(max(0, status.getLen() - 64), min(64, status.getLen()))
    finally:
        file.close()


def _at(file, at: int):
    file.seek(at)
    return file


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """The items of datasets that have one item a line."""
    return spark.read.schema(ITEM).json(path)


def write_item_lines(items: DataFrame, path: str) -> None:
    """One item a line, in as many files as tasks; :func:`read_item_lines` gives the same rows back."""
    items.write.mode("overwrite").json(path)


def write_document(items: DataFrame, path: str, name: str = "items", head: dict | None = None, indent: int = 2, ensure_ascii: bool = False) -> None:
    """One JSON document at ``path``: the fields of ``head``, then all rows as the list ``name``, laid out as ``json.dump`` does with ``indent``.

    Tasks write the rows as texts; their files are then copied one behind the
    other into the document, as streams of bytes, so no process holds more than
    a row.  Rows come in the order of ``items``; null fields are written as null,
    and an empty table gives an empty list.  The document appears when it is
    whole, in place of an older one.
    """
    spark = items.sparkSession
    pad = " " * indent

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dumped = (json.dumps(json.loads(row), indent=indent, ensure_ascii=ensure_ascii) for row in batch["row"])
            yield pd.DataFrame({"value": ["\n".join(f"{pad}{pad}{line}" for line in text.split("\n")) for text in dumped]})

    parts = f"{scratch_root(spark)}/documents/{uuid.uuid4().hex}"
    rows = items.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns]), {"ignoreNullFields": "false"}).alias("row"))
    rows.mapInPandas(shown, "value string").write.option("lineSep", ",\n").text(parts)
    opened = "".join(f"{pad}{json.dumps(k)}: {_indented(v, indent, ensure_ascii)},\n" for k, v in (head or {}).items())
    _join_files(spark, parts, path, f"{{\n{opened}{pad}{json.dumps(name)}: [", ",\n", f"\n{pad}]\n}}", "]\n}")


def write_results(results: DataFrame, folder: str, indent: int = 2) -> None:
    """A document ``results_<model>.json`` under ``folder`` for each model: ``model``, ``n_results`` and ``raw_results`` by key, as :func:`read_results` reads it.

    ``results`` is ``model, key, ...``, each key once for a model.  One job
    writes the entries of all models as texts, whose files are then copied
    together; a null model is the model ``null``, and names are quoted in paths.
    """
    spark = results.sparkSession
    pad = " " * indent

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = (f"{pad}{pad}{json.dumps(k)}: {_indented(json.loads(row), indent, True, 2)}" for k, row in zip(batch["key"], batch["row"], strict=True))
            yield pd.DataFrame({"model": batch["model"], "value": list(entries)})

    named = results.withColumn("model", F.coalesce("model", F.lit("null"))).withColumn("row", F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns if c not in ("model", "key")]), {"ignoreNullFields": "false"}))
    parts = f"{scratch_root(spark)}/documents/{uuid.uuid4().hex}"
    texts = named.select(F.base64(F.encode("model", "UTF-8")).alias("model"), "key", "row").mapInPandas(shown, "model string, value string")
    texts.withColumn("of", F.translate("model", "+/=", "-_.")).select("of", "value").write.partitionBy("of").option("lineSep", ",\n").text(parts)
    for model, coded, n in named.groupBy("model").agg(F.translate(F.base64(F.encode("model", "UTF-8")), "+/=", "-_."), F.count("*")).collect():  # a row for each model
        before = f'{{\n{pad}"model": {json.dumps(model)},\n{pad}"n_results": {n},\n{pad}"raw_results": {{'
        _join_files(spark, f"{parts}/of={coded}", f"{folder}/results_{quote(model, safe='')}.json", before, ",\n", f"\n{pad}}}\n}}", "}\n}")


def _indented(value: object, indent: int, ensure_ascii: bool, depth: int = 1) -> str:
    return json.dumps(value, indent=indent, ensure_ascii=ensure_ascii).replace("\n", "\n" + " " * indent * depth)


def _join_files(spark: SparkSession, parts: str, path: str, before: str, between: str, after: str, after_none: str) -> None:
    """The files of ``parts``, each row of which ends in ``between``, as one file; the last row loses that end."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    source, fs = folder.getFileSystem(conf), target.getFileSystem(conf)
    files = sorted(((s.getPath().getName(), s.getPath(), s.getLen()) for s in source.listStatus(folder) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda x: x[0])
    scratch = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(scratch)
    out.write(bytearray((before + "\n" * bool(files)).encode()))
    for i, (_, file, size) in enumerate(files):
        read = source.open(file)
        jvm.org.apache.commons.io.IOUtils.copyLarge(read, out, 0, size - len(between.encode()) * (i == len(files) - 1))
        read.close()
    out.write(bytearray((after if files else after_none).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(scratch, target)
    source.delete(folder, True)


def write_report(report: DataFrame, path: str, head: dict | None = None) -> None:
    """A report's rows as a document with ``rows``."""
    write_document(report, path, "rows", head)


def with_ordinal_ids(rows: DataFrame, ordinal: str, prefix: str) -> DataFrame:
    """``rows`` with ``item_id`` made of a stored ordinal: prefix, underscore and four digits at least."""
    return rows.withColumn("item_id", F.format_string(f"{prefix}_%04d", F.col(ordinal)))


def nested(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Items with their variants, from flat variants ``parent_id, variant_no, ...`` and the items' own rows.

    An item's variants are few (the generator's K), so a row holds them.  An item
    without variants has an empty list.
    """
    fields = [c for c in rows.columns if c not in ("parent_id", "variant_no")]
    packed = rows.groupBy(F.col("parent_id").alias("item_id")).agg(F.sort_array(F.collect_list(F.struct("variant_no", F.struct(*fields).alias("v")))).alias("some"))
    joined = originals.join(packed, "item_id", "left")
    kind = f"array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields if f.name in fields)}>>"
    return joined.withColumn("variants", F.coalesce(F.transform("some", lambda x: x["v"]), F.array().cast(kind))).drop("some")


def flatten(items: DataFrame) -> DataFrame:
    """``parent_id, item_id, question, answer, is_original, variant_no``: a row for each item and each of its variants; null lists have none."""
    row = lambda v, original, at: F.struct(F.col("item_id").alias("parent_id"), v["item_id"].alias("item_id"), v["question"].alias("question"), v["answer"].alias("answer"), F.lit(original).alias("is_original"), at.cast("int").alias("variant_no"))
    own = F.array(row({c: F.col(c) for c in ("item_id", "question", "answer")}, True, F.lit(0)))
    # one pass over the items, which may be read from a document
    return items.select(F.explode(F.concat(own, F.coalesce(F.transform("variants", lambda v, i: row(v, False, i + 1)), F.slice(own, 1, 0)))).alias("x")).select("x.*")


def totals(items: DataFrame) -> DataFrame:
    """``n_items, n_variants``."""
    return items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum(F.when(F.col("variants").isNull(), 0).otherwise(F.size("variants"))), F.lit(0)).alias("n_variants"))


def existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The files or globs of ``paths`` that exist, as one scan; those that don't are passed over."""
    found = []
    for path in paths:
        try:
            spark.read.schema(schema).json(path)  # looks the path up, reads nothing
            found.append(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    reader = spark.read.schema(schema).option("multiLine", True)
    return reader.json(found) if found else spark.createDataFrame([], schema)


#: What stands between two results of a document that :func:`write_results` lays out, what opens and what ends their map.
RESULT_BETWEEN, RESULT_OPENED, RESULT_CLOSED = '\n    },\n    "', '\n  "raw_results": {\n    "', "\n    }\n  }\n}"
#: Bytes from which on a document of results is looked at for that layout; smaller ones are one task's work in any case.
SPLIT_FROM = 32 << 20


def read_results(spark: SparkSession, paths: list[str], split_from: int = SPLIT_FROM) -> DataFrame:
    """``model, key, item_id, trial, ...``: every result of every file; a file without a model takes its own name for one.

    Documents of ``split_from`` bytes or more that are laid out as
    :func:`write_results` does are read in splits, all others by one task each.
    """
    laid, rest = [], []
    for path in paths:
        found = _results_layout(spark, path, split_from)
        laid += [(p, model) for p, laid_out, model in found if laid_out]
        rest += [p for p, laid_out, _ in found if not laid_out] if any(laid_out for _, laid_out, _ in found) else [path]
    parts = [_laid_results(spark, laid)] if laid else []
    if rest or not laid:
        parts.append(existing(spark, rest, RESULTS).select(F.input_file_name().alias("file"), "model", "raw_results"))
    files = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    name = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    # outer: of a plain explode the optimizer infers a filter, by which each piece would be parsed again
    rows = files.select(F.coalesce("model", name).alias("model"), F.explode_outer("raw_results").alias("key", "r")).filter("key is not null")
    return rows.select("model", "key", "r.*")


def _results_layout(spark: SparkSession, path: str, split_from: int) -> list[tuple[str, bool, str | None]]:
    """The files of a path or glob, whether each is large and laid out as results, and its model; empty if there is none or some aren't files.  Reads large files' ends only."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in (fs.globStatus(target) or [])]
    if not all(s.isFile() for s in found):
        return []
    listed = []
    for s in found:
        laid_out, model = False, None
        if s.getLen() >= split_from:
            head, tail = _ends(jvm, fs, s)
            before, opened, _ = head.partition(RESULT_OPENED)
            try:
                fields = json.loads(before.rstrip().rstrip(",") + "}") if opened and tail.rstrip().endswith(RESULT_CLOSED) and RESULT_BETWEEN not in before else {"model": 0}
                model = fields.get("model")
                laid_out = model is None or isinstance(model, str)
            except ValueError:
                pass
        listed.append((re.sub(r"([\\\[\]{}*?,])", r"\\\1", s.getPath().toString()), laid_out, model))
    return listed


def _laid_results(spark: SparkSession, files: list[tuple[str, str | None]]) -> DataFrame:
    """``file, model, raw_results`` of laid out documents: each result begins and ends on lines of its own, and no JSON text holds a raw line end, so results are found wherever a file is split."""
    place = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    jvm = spark._jvm
    uri = lambda p: jvm.org.apache.hadoop.fs.Path(re.sub(r"\\(.)", r"\1", p)).toUri().toString()
    models = spark.createDataFrame(list({uri(p): (uri(p), model) for p, model in files}.values()), "at string, own string").select(place(F.col("at")).alias("at"), "own", F.lit(True).alias("known"))
    pieces = spark.read.option("lineSep", RESULT_BETWEEN).text([p for p, _ in files]).select(F.input_file_name().alias("file"), "value")
    # patterns are tried on a file's first and last piece only: others open with a key and hold no line that closes the map
    text = F.when(F.startswith("value", F.lit("{")), F.element_at(F.split("value", re.escape(RESULT_OPENED), 2), -1)).otherwise(F.col("value"))
    ended = F.regexp_replace(text, r"\n    \}\n  \}\n\}\s*\z", "")
    whole = F.when(~F.contains("value", F.lit("\n  }")), text).when(F.contains(ended, F.lit("\n  }")), F.raise_error(F.lit("something follows the results"))).otherwise(ended)
    rows = pieces.withColumn("at", place(F.col("file"))).join(F.broadcast(models), "at", "left")
    model = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown file "), "file"))).otherwise(F.col("own"))
    return rows.select("file", model.alias("model"), F.from_json(F.concat(F.lit('{"'), whole, F.lit("}}")), f"map<string,{RESULT}>").alias("raw_results"))


def append_results(new: DataFrame, path: str) -> None:
    """Appends results that ``path`` doesn't have yet, in one commit of its log; a second call with the same rows adds none.

    Several writers may append at once; ``ResultLog(spark, path).read()`` gives the rows.
    """
    ResultLog(new.sparkSession, path).merge(new)


def reuse_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
