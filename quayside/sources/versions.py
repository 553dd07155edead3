"""Tables in versions: a version is written beside the others and counts once its manifest stands in its place, which is one rename.

A manifest names the folder of each part of the table, so a version that changes a few parts shares the others with those before it. A write that dies before
the rename leaves the last version as it was; what it has written is removed by vacuum(). All files are those of Spark's own file system, so any store
whose rename doesn't replace a file will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Versions of a table in a folder, by a growing number: a batch, a day, a run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._fs.Path("/".join([self.path, *names]))

    def committed(self) -> list[int]:
        """Numbers of the versions that count, rising."""
        folder = self._at("_versions")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int) -> dict[str, str]:
        """part: folder of a version."""
        text = self.spark.read.text(f"{self.path}/_versions/{version}.json", wholetext=True).first()
        return json.loads(text[0])["parts"]

    def latest(self, before: int | None = None) -> dict[str, str]:
        """The manifest of the last version, or of the last before a number; empty if there is none."""
        known = [n for n in self.committed() if before is None or n < before]
        return self.manifest(known[-1]) if known else {}

    def read(self, schema: str, parts: list[str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the last version (before a number), of all its parts or those that are named; no rows where there is no version, or none has them."""
        held = self.latest(before)
        folders = sorted({f for name, f in held.items() if parts is None or name in parts})
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(empty.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else empty

    def write(self, version: int, parts: dict[str, DataFrame]) -> bool:
        """A version of whole parts; parts that aren't named are as in the version before. False, with nothing written, if that version counts already."""
        if version in self.committed():
            return False
        made = {}
        for name, rows in parts.items():
            made[name] = f"data/{version}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{made[name]}")
        return self._commit(version, self.latest(version) | made)

    def write_buckets(self, version: int, rows: DataFrame, bucket: str, touched: list[int], name: str = "") -> bool:
        """A version in which the buckets that are touched hold just these rows (of which bucket says where they belong), and all others stay as they were."""
        if version in self.committed():
            return False
        folder = f"data/{version}-{uuid.uuid4().hex}"
        rows.repartition(bucket).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        there = {f.getPath().getName() for f in self._files.listStatus(self._at(folder))}
        made = {f"{name}{b}": f"{folder}/{bucket}={b}" for b in touched if f"{bucket}={b}" in there}
        gone = {f"{name}{b}" for b in touched} - made.keys()
        return self._commit(version, {k: v for k, v in (self.latest(version) | made).items() if k not in gone})

    def _commit(self, version: int, parts: dict[str, str]) -> bool:
        draft, place = self._at("_versions", f".{version}-{uuid.uuid4().hex}"), self._at("_versions", f"{version}.json")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        finally:
            out.close()
        kind = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # another writer's version of that number isn't replaced: an error
        self._fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, options)
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` versions, and folders that none of these names, also those of writes that died; none may be under way. Returns what went."""
        known = self.committed()
        stay, gone = known[-keep:] if keep else [], []
        held = {f for n in stay for f in self.manifest(n).values()}
        for n in known:
            if n not in stay:
                self._files.delete(self._at("_versions", f"{n}.json"), False)
        for folder in self._files.listStatus(self._at("data")) if self._files.exists(self._at("data")) else []:
            name = f"data/{folder.getPath().getName()}"
            inner = [f"{name}/{f.getPath().getName()}" for f in self._files.listStatus(folder.getPath()) if f.isDirectory()]
            idle = [name] if not any(h == name or h.startswith(f"{name}/") for h in held) else [f for f in inner if f not in held and name not in held]
            for f in idle:
                self._files.delete(self._at(f), True)
            gone += idle
        return gone


def kept_on_failure(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new lacks: what a refresh couldn't fetch stays as it was."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))


def bucket_of(key: str, buckets: int):
    """0 to buckets - 1 by a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
