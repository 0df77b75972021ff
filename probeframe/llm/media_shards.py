"""Media payloads by content, in tar shards (operator 2).

A payload is stored as an 8-bit grey image (PNG), 64 samples wide, once for
each distinct content.  The tar member's name is the sha256 of the stored bytes.
A table row carries ``digest``, ``shard``, ``offset`` and ``length``;
:func:`header_columns` fills width, height, depth and the unpadded size by
reading the first 73 bytes of each member and nothing else.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import materialize, meet, scratch_path, small_batches

WIDTH = 64
#: Signature, IHDR and the chunk that holds the unpadded length.
HEADER_BYTES = 8 + 25 + 12 + 28
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: Bits of the filter that finds texts which may repeat, and bits that a text sets: 4 MB whatever the input.
FILTER_BITS, FILTER_PROBES = 1 << 25, 4
PLACE = "digest string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    """``data``, padded by zeros to a positive multiple of 64, as a grey image; lossless."""
    rows = max(1, -(-len(data) // WIDTH))
    grid = np.zeros((rows, WIDTH + 1), np.uint8)  # a filter byte of zero, then the samples
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    grid[:, 1:] = flat.reshape(rows, WIDTH)
    return b"".join(
        [
            b"\x89PNG\r\n\x1a\n",
            _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)),
            _chunk(b"tEXt", b"n_bytes\0" + b"%020d" % len(data)),
            _chunk(b"IDAT", zlib.compress(grid.tobytes(), 6)),
            _chunk(b"IEND", b""),
        ]
    )


def parse_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and unpadded bytes, from a member's first 73 bytes."""
    width, height, depth = struct.unpack_from(">IIB", head, 16)
    return width, height, depth, int(head[49:69])


def decode_png(media: bytes) -> bytes:
    """The samples of :func:`encode_png`'s image."""
    at, found = 8, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        if kind == b"IDAT":
            found.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    grid = np.frombuffer(zlib.decompress(b"".join(found)), np.uint8).reshape(-1, WIDTH + 1)
    if grid[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return grid[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share that is zero."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = float((counts * values).sum() / n)
    dev = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    p = counts[counts > 0] / n
    return f"mean={mean:.4f};std={dev:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zero={counts[0] / n:.4f}"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Shard:
    """A tar file under way; it gets its name when it is whole, so a lost task leaves none."""

    def __init__(self, root: str, name: str) -> None:
        self.fs, base = _store(root)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path = name, f"{base}/{name}"
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        self.out, self.at, self.places = self.fs.open_output_stream(self.part), 0, {}

    def put(self, media: bytes) -> tuple[str, int]:
        digest = hashlib.sha256(media).hexdigest()
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT) if len(media) < 8**11 else info.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + media + b"\0" * (-len(media) % 512))
            self.places[digest] = self.at + len(head)
            self.at += len(head) + len(media) + -len(media) % 512
        return digest, self.places[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def repeated_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the ``key`` values that occur more than once, as 64-bit words; its size is fixed."""
    repeated = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bits = repeated.select(F.explode(F.array(*_probes(F.col("key")))).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("word")).toPandas()
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return found.view(np.uint64)


def _probes(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(FILTER_BITS)) for j in range(FILTER_PROBES)]


def write_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Stores every distinct text's bytes once; returns the index ``doc_id, shared, digest, shard, offset, length`` (a written table) and the shards' folder.

    Texts that occur once are written by the task that reads them.  Those that a
    filter of fixed size takes for repeated (``shared``; it errs to that side
    only) are first combined by content, on the map side too, so that a text
    with a third of all rows moves once a task; their rows then join the places
    by content.  A null text is empty, an empty one is one row of 64 zeros;
    repeated rows stay rows; equal texts have equal places; other columns are
    not read; an empty table has an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = scratch_path(spark, "shards")

    def to_shards(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, part, k = None, TaskContext.get().partitionId(), 0
            for batch in batches:
                places = []
                for t in batch.pop("text"):
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard, k = _Shard(root, f"{kind}-{part:06d}-{k:04d}.tar"), k + 1
                    media = encode_png(t.encode())
                    digest, offset = shard.put(media)
                    places.append((digest, shard.name, offset, len(media)))
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(places, columns=[c.split()[0] for c in PLACE.split(", ")])], axis=1)
            if shard:
                shard.close()

        return run

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    known = spark.sparkContext.broadcast(repeated_filter(rows.select("key")))

    @F.pandas_udf("boolean")
    def may_repeat(*bits: pd.Series) -> pd.Series:
        found = np.ones(len(bits[0]), bool)
        for b in bits:
            at = b.to_numpy(np.int64)
            found &= (known.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    flag = may_repeat(*_probes(F.col("key")))
    alone = rows.filter(~flag).select("doc_id", "text").mapInPandas(to_shards("one"), f"doc_id long, {PLACE}")
    repeats = rows.filter(flag)
    contents = repeats.groupBy("key").agg(F.first("text").alias("text")).sortWithinPartitions("key")
    places = materialize(contents.mapInPandas(to_shards("many"), f"key binary, {PLACE}"), "places")
    members = meet(materialize(repeats.select("doc_id", "key"), "members"), places, ["key"])
    columns = ["doc_id", "shared", "digest", "shard", "offset", "length"]
    index = alone.withColumn("shared", F.lit(False)).select(*columns).union(members.withColumn("shared", F.lit(True)).select(*columns))
    return materialize(index, "index"), root


def _by_place(index: DataFrame) -> DataFrame:
    """Rows dealt by megabyte of shard, in reading order, so that a task reads neighbouring ranges."""
    place = F.floor(F.col("offset") / (1 << 20))
    return index.repartition("shard", place).sortWithinPartitions("shard", "offset")


class _Ranges:
    """Range reads of shards; one file stays open."""

    def __init__(self, root: str) -> None:
        self.fs, self.base = _store(root)
        self.name, self.file = "", io.BytesIO()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def _per_content(index: DataFrame, root: str, read: Callable[[_Ranges, tuple], tuple], added: str) -> DataFrame:
    """``index`` with the columns ``added`` that ``read`` makes of each stored content; one read for each, however many rows share it."""
    given = [(f.name, f.dataType.simpleString()) for f in index.schema.fields]
    schema = ", ".join(f"{n} {t}" for n, t in given) + ", " + added
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = _Ranges(root)
        for batch in batches:
            made = [read(ranges, row) for row in batch.itertuples(index=False)]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1).astype({"doc_id": "Int64"})

    alone = _by_place(index.filter("not shared")).mapInPandas(run, schema)
    shared = index.filter("shared")
    contents = shared.groupBy(*[c for c in index.columns if c != "doc_id"]).agg(F.lit(None).cast("long").alias("doc_id")).select(*index.columns)
    found = materialize(_by_place(contents).mapInPandas(run, schema).drop("doc_id"), "contents")
    members = materialize(shared.select("doc_id", "digest"), "members")
    return alone.unionByName(meet(members, found, ["digest"]))


def header_columns(index: DataFrame, root: str) -> DataFrame:
    """The index with ``width, height, depth, n_bytes``, from range reads of 73 bytes a content; null ids stay, an empty index stays empty."""
    read = lambda ranges, row: parse_header(ranges.read(row.shard, row.offset, HEADER_BYTES))
    return materialize(_per_content(index, root, read, "width long, height long, depth long, n_bytes long"), "headers")


def read_media(index: DataFrame, root: str) -> DataFrame:
    """One row per document, from the stored bytes: sizes, digests and features, with its place and what the header says.

    ``index`` comes with or without :func:`header_columns`; null ids stay, an
    empty index stays empty.
    """
    small_batches(index.sparkSession)
    index = index if "n_bytes" in index.columns else header_columns(index, root)

    def read(ranges: _Ranges, row: tuple) -> tuple:
        media = ranges.read(row.shard, row.offset, row.length)
        stored = hashlib.sha256(media).hexdigest()
        if stored != row.digest:
            raise OSError(f"{row.shard} at {row.offset}: content does not match its address")
        data = decode_png(media)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), stored, features(data)

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _per_content(index, root, read, added).drop("shared")
