"""Cache tables in versions: namespaces of rows by key, each version a table of its own behind a log.

A version's rows are written first, under a name that nobody else uses; then a log entry takes the next number by a rename, which
succeeds for one writer only. So readers never see half a version, a reader of an old one is not disturbed by later ones, and of
two writers that start from one version the slower one begins anew. The store must refuse to rename onto a file, as HDFS does; a
POSIX folder is asked first, and where a store can do neither, one writer at a time must be assured otherwise.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 2  # versions that a clean-up leaves


def key_of(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24)


class Conflict(Exception):
    """Another writer made the version first."""


class CacheTables:
    """Rows of a namespace have ``key`` and ``fetched_at`` (null: never expires) and any other columns. Disabled, all operations do nothing."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True, tries: int = 5):
        self.spark, self.root, self.enabled, self.tries = spark, root.rstrip("/"), enabled, tries

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self, namespace: str) -> list[int]:
        """Numbers of the versions in the log, oldest first."""
        return [int(n.split(".")[0]) for n in self._names(namespace, "log") if n.endswith(".json")]

    def entry(self, namespace: str, version: int) -> dict:
        """What the log says of a version: folder (null for an empty one) and operation."""
        path, _ = self._path(namespace, "log", f"{version:012d}.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def read(self, namespace: str, version: int | None = None) -> DataFrame | None:
        """A version's rows, the latest one's by default; none before the first and after a clearing."""
        known = self.versions(namespace) if self.enabled else []
        if not known or (folder := self.entry(namespace, known[-1] if version is None else version)["folder"]) is None:
            return None
        return self.spark.read.parquet(f"{self.root}/{namespace}/{folder}")

    def _commit(self, namespace: str, base: int, rows: DataFrame | None, operation: str) -> int:
        folder = None if rows is None else f"rows-{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.parquet(f"{self.root}/{namespace}/{folder}")
        path, fs = self._path(namespace, "log", f"{base + 1:012d}.json")
        # written whole under a name that no listing takes, then renamed, which fails where the entry exists
        part, _ = self._path(namespace, "log", f".{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"folder": folder, "operation": operation}).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(part, path, self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{namespace} {base + 1}") from e
            raise
        return base + 1

    def change(self, namespace: str, to: Callable[[DataFrame | None], DataFrame | None], operation: str) -> int:
        """A new version of what ``to`` makes of the latest one; begins anew where another writer was faster. Gives its number."""
        if not self.enabled:
            return 0
        for attempt in range(self.tries):
            base = max(self.versions(namespace), default=0)
            try:
                return self._commit(namespace, base, to(self.read(namespace) if base else None), operation)
            except Conflict:
                if attempt == self.tries - 1:
                    raise
        raise AssertionError

    def put(self, namespace: str, rows: DataFrame) -> int:
        """New rows in place of those of their keys; one row of each key (the last fetched) counts."""
        rest = [c for c in rows.columns if c != "key"]
        new = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(F.col("fetched_at").isNull(), "fetched_at")).alias("r")).select("key", "r.*").select(*rows.columns)

        def merged(old: DataFrame | None) -> DataFrame:
            return new if old is None else old.join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True)

        return self.change(namespace, merged, "put")

    def prune(self, namespace: str, before) -> int:
        """Without the rows that were fetched before a time; those without a time stay."""
        kept = F.col("fetched_at").isNull() | (F.col("fetched_at") >= F.lit(before))
        return self.change(namespace, lambda old: None if old is None else old.where(kept), "prune")

    def clear(self, namespace: str) -> int:
        return self.change(namespace, lambda old: None, "clear")

    def vacuum(self, namespace: str, keep: int = KEPT) -> int:
        """Deletes the rows of all versions but the last ones, and rows that no version names; gives how many folders went.

        Not while others write: rows on their way to a version have no name yet.
        """
        if not self.enabled:
            return 0
        used = {self.entry(namespace, v)["folder"] for v in self.versions(namespace)[-keep:]}
        gone = [n for n in self._names(namespace) if n.startswith("rows-") and n not in used]
        for name in gone:
            path, fs = self._path(namespace, name)
            fs.delete(path, True)
        return len(gone)
