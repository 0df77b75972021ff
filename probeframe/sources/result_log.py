"""A table of results with one row for each key, kept by a log of commits.

Data go to folders of their own; a commit is one small file that names such a
folder and comes into being in a single step, or not at all if another writer
was first.  Readers follow the log, so a write that was killed before its commit
is never seen, and two writers can't store one key twice: who loses the race
looks again at what is stored by now.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version long, folder string, base boolean, updates boolean, app string, batch long, n_rows long"
#: Columns that the log adds to the stored rows.
OWN = ["__bucket", "__hash", "__version"]


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Snapshot:
    """What the log says at one version: folders in the order of their commits, and the last batch of each app."""

    version: int
    folders: tuple[tuple[int, str], ...]
    updates: bool
    batches: dict[str, int]


class ResultLog:
    """The table at ``path`` with a row for each value of ``keys``.

    :meth:`merge` adds rows with new keys and replaces those whose key is stored
    with other values; rows that are stored already change nothing.  Only keys
    and hashes of the buckets that a batch touches are read for it, and only new
    or changed rows are written.  Replaced rows stay in their folder until
    :meth:`compact`; :meth:`read` leaves them out.  Null keys are keys.

    A commit is a hard link on a local file system and else a rename that fails
    if its target exists, which HDFS does in one step; a store without such a
    rename can't hold the log.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("model", "key"), buckets: int = 64, tries: int = 20) -> None:
        self.spark, self.path, self.keys, self.buckets, self.tries = spark, path.rstrip("/"), list(keys), buckets, tries

    def snapshot(self) -> Snapshot:
        """The newest version; -1 for a table that doesn't exist yet."""
        try:
            log = self.spark.read.schema(ENTRY).json(f"{self.path}/log")
            since = log.filter("base").agg(F.max("version")).first()[0] or 0
            # the entries since the last compaction: one a commit
            entries = log.filter(F.col("version") >= since).orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            entries = []
        batches: dict[str, int] = {}
        for e in entries:
            for app, batch in json.loads(e["app"] or "{}").items():
                batches[app] = batch
        folders = tuple((e["version"], e["folder"]) for e in entries if e["folder"])
        return Snapshot(entries[-1]["version"] if entries else -1, folders, any(e["updates"] for e in entries), batches)

    def read(self, at: Snapshot | None = None) -> DataFrame | None:
        """The rows of a snapshot, the newest by default; None if nothing was ever stored."""
        stored = self._stored(at or self.snapshot())
        return None if stored is None else stored.drop(*OWN)

    def _stored(self, at: Snapshot, columns: list[str] | None = None) -> DataFrame | None:
        if not at.folders:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/data/{folder}").withColumn("__version", F.lit(version)) for version, folder in at.folders]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        if columns:
            rows = rows.select(*columns)
        if at.updates:  # of a key that was replaced the last row holds
            rest = [c for c in rows.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__version").alias("last")).select(*self.keys, "last.*")
        return rows

    def _keyed(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """One row a key of ``new``, the largest of those that repeat, with its bucket, the hash of its other columns and the one that ``old`` has for the key.

        New rows and old hashes meet in one grouping, so each is shuffled once.
        """
        rest = [c for c in new.columns if c not in self.keys]
        rows = new.select(*self.keys, F.struct(*rest).alias("row"))
        if old is not None:
            kind = rows.schema["row"].dataType
            rows = rows.withColumn("__was", F.lit(None).cast("string")).unionByName(old.select(*self.keys, F.lit(None).cast(kind).alias("row"), F.col("__hash").alias("__was")))
        was = [F.max("__was").alias("__was")] if old is not None else []
        one = rows.groupBy(*self.keys).agg(F.max("row").alias("row"), *was).filter("row is not null").select(*self.keys, "row.*", *(["__was"] if old is not None else [F.lit(None).cast("string").alias("__was")]))
        # 128 bits as 24 characters: hashes don't compress, and are stored and shuffled with each row
        code = F.base64(F.unhex(F.substring(F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256), 1, 32)))
        return one.withColumn("__bucket", self._bucket()).withColumn("__hash", code)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, app: str | None = None, batch: int = 0) -> int:
        """Stores ``new`` in one commit and returns the version that holds it.

        With ``app``, a batch that the app has committed already is passed over,
        so that a run again after a failure changes nothing.
        """
        for _ in range(self.tries):
            at = self.snapshot()
            if app and at.batches.get(app, -1) >= batch:
                return at.version
            folder, updates, n = self._write(new, at)
            try:
                return self._commit(at, folder, updates=updates, batches={app: batch} if app else {}, n_rows=n)
            except Conflict:
                continue  # the folder stays unseen; vacuum() removes it
        raise Conflict(f"{self.tries} commits were lost to other writers")

    def _write(self, new: DataFrame, at: Snapshot) -> tuple[str | None, bool, int]:
        """Writes what ``new`` adds to a snapshot: the folder, whether it replaces rows, and its number of rows."""
        old = self._stored(at, [*self.keys, *OWN])
        if old is not None:
            touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
            old = old.filter(F.col("__bucket").isin(touched))
        rows = self._keyed(new, old).filter("__was is null or __was <> __hash").withColumn("__replaces", F.col("__was").isNotNull()).drop("__was")
        folder = uuid.uuid4().hex
        where = f"{self.path}/data/{folder}"
        rows.write.partitionBy("__bucket").parquet(where)
        n, replaced = self._counts(where, rows)
        return (folder if n else None), replaced > 0, n

    def _counts(self, where: str, rows: DataFrame) -> tuple[int, int]:
        written = self.spark.read.schema(rows.schema).parquet(where)
        return tuple(written.agg(F.count("*"), F.count_if("__replaces")).first())

    def compact(self) -> int:
        """Writes the newest snapshot as one folder, without replaced rows; what comes before isn't read any more."""
        for _ in range(self.tries):
            at = self.snapshot()
            stored = self._stored(at)
            if stored is None:
                return at.version
            folder = uuid.uuid4().hex
            stored.drop("__version").withColumn("__replaces", F.lit(False)).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
            try:
                return self._commit(at, folder, base=True, batches=at.batches)
            except Conflict:
                continue
        raise Conflict(f"{self.tries} commits were lost to other writers")

    def _commit(self, at: Snapshot, folder: str | None, base: bool = False, updates: bool = False, batches: dict[str, int] | None = None, n_rows: int | None = None) -> int:
        version = at.version + 1
        entry = {"version": version, "folder": folder, "base": base, "updates": updates, "app": json.dumps(batches or {}), "n_rows": n_rows}
        self._create(f"{self.path}/log/{version:020d}.json", json.dumps(entry))
        return version

    def _create(self, path: str, text: str) -> None:
        """A file that is there at once and whole, or Conflict if it is there already."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        scratch = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        if fs.getUri().getScheme() == "file":
            here, there = urlparse(scratch.toString()).path, urlparse(target.toString()).path
            with open(here, "w") as f:
                f.write(text)
            try:
                os.link(here, there)
            except FileExistsError:
                raise Conflict(path) from None
            finally:
                os.unlink(here)
            return
        out = fs.create(scratch)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(scratch, target, options)
        except Exception as e:
            fs.delete(scratch, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from None
            raise

    def orphans(self) -> Iterator[str]:
        """Data folders that the newest snapshot doesn't name: of killed writes, of lost races, and those before a compaction."""
        kept = {folder for _, folder in self.snapshot().folders}
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(data) if fs.exists(data) else ():
            if status.getPath().getName() not in kept:
                yield status.getPath().toString()

    def vacuum(self) -> int:
        """Removes :meth:`orphans`; for a time when nobody writes or reads older snapshots."""
        gone = list(self.orphans())
        for path in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(gone)
