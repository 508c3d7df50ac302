"""Shards with size-tiered compaction and a versioned manifest.

A store is a folder that all executors share: data/ holds immutable Parquet shards, manifests/ one JSON file for each version. Arrivals are
appended as they come, in small shards. When a tier (shards of similar size) has enough of them, they are merged into files of the
target size, without a shuffle. Every change writes a new manifest beside the last and renames it: a reader sees one version or the next, and of two
writers one fails and tries again. That needs a file system whose rename is one step and fails if the target is there, as HDFS's is; a local folder checks and
renames in two steps, which serves one driver at a time; an object store without such a rename needs a table format's commit service instead.
Old shards stay until vacuum().
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """ddl: the rows' schema. The driver holds names and sizes of shards only.

    An empty arrival adds a version without shards' rows. Null values, repeated rows, empty and very long texts are kept as they are; columns that ddl doesn't
    name are left out, whatever their names; a column that ddl names twice or an arrival lacks raises.
    """

    def __init__(self, spark: SparkSession, root: str, ddl: str, target: int = 128 << 20, least: int = 1 << 20, fanout: int = 4):
        self.spark, self.root, self.ddl, self.target, self.least, self.fanout = spark, root.rstrip("/"), ddl, target, least, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """Of a version, the last if none is given; none before the first."""
        known = self.versions()
        if version is None and not known:
            return []
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        stream = self._fs.open(self._path(self._name(known[-1] if version is None else version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def commit(self, before: int, shards: list[Shard]) -> int:
        """Version before + 1. Conflict if it is there already."""
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps({"version": before + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        target = self._path(self._name(before + 1))
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without the option to overwrite: fails if the version is there
            files.rename(temporary, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            raise Conflict(f"version {before + 1} is taken") from None
        return before + 1

    def _change(self, gone: set[str], new: list[Shard], tries: int = 10) -> int:
        for _ in range(tries):
            before = (self.versions() or [0])[-1]
            now = self.shards(before) if before else []
            if not gone <= {s.path for s in now}:
                raise Conflict("a shard to replace is gone")
            try:
                return self.commit(before, [s for s in now if s.path not in gone] + new)
            except Conflict:
                continue
        raise Conflict("too many writers")

    def _write(self, rows: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._listed(folder)

    def _listed(self, folder: str) -> list[Shard]:
        found = self._fs.listStatus(self._path(folder))
        return [Shard(f"{folder}/{x.getPath().getName()}", int(x.getLen())) for x in found if x.getPath().getName().startswith("part-")]

    def _names(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.ddl).schema]

    def append(self, rows: DataFrame) -> int:
        return self._change(set(), self._write(rows.select(*self._names())))

    def arrivals(self, rows: DataFrame, column: Column) -> Iterator[int]:
        """Writes all rows in one pass, in a folder for each value of column; then appends the folders in order, a version each, as the caller asks for them."""
        folder, by = f"{self.root}/data/{uuid.uuid4().hex}", "__arrival"
        rows.select(*self._names(), column.cast("long").alias(by)).write.partitionBy(by).option("compression", "zstd").parquet(folder)
        parts = [x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if x.isDirectory()]
        for name in sorted((n for n in parts if n.startswith(f"{by}=")), key=lambda n: (not n[len(by) + 1 :].lstrip("-").isdigit(), int(n[len(by) + 1 :]) if n[len(by) + 1 :].lstrip("-").isdigit() else 0)):
            yield self._change(set(), self._listed(f"{folder}/{name}"))

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.least, self.fanout))) if shard.bytes > self.least else 0

    def compact(self) -> int:
        """Merges until no tier below the target has `fanout` shards; the last version."""
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in self.shards():
                if s.bytes < self.target // 2:
                    tiers.setdefault(self.tier(s), []).append(s)
            full = [(t, x) for t, x in sorted(tiers.items()) if len(x) >= self.fanout]
            if not full:
                return (self.versions() or [0])[-1]
            run = full[0][1]
            total = sum(s.bytes for s in run)
            merged = max(1, round(total / self.target))
            new = self._write(self._rows(run).coalesce(merged))
            self._change({s.path for s in run}, new)

    def _rows(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*(s.path for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.shards(version))

    def full_tiers(self) -> int:
        """Tiers below the target that have enough shards to be merged."""
        count = Counter(self.tier(s) for s in self.shards() if s.bytes < self.target // 2)
        return sum(n >= self.fanout for n in count.values())

    def vacuum(self, keep: int = 1, grace_s: float = 86_400) -> int:
        """Deletes older manifests than the last `keep`, and the shards that only these name; how many shards.

        A shard that no manifest names may be one that a writer is about to commit: it goes only once its file is older than grace_s, which must be longer
        than any write and commit take. Manifests go after their shards, so that a vacuum that stops midway is done again by the next.
        """
        known = self.versions()
        named = {s.path for v in known[-keep:] for s in self.shards(v)}
        dropped = {s.path for v in known[:-keep] for s in self.shards(v)} - named
        for path in dropped:
            self._fs.delete(self._path(path), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(self._name(v)), False)
        data, gone, until = self._path(f"{self.root}/data"), len(dropped), time.time() - grace_s
        found = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        while found is not None and found.hasNext():
            file = found.next()
            path = f"{self.root}/data/{file.getPath().toString().split(f'{self.root.split("://")[-1]}/data/', 1)[1]}"
            if path not in named and file.getModificationTime() / 1000 < until:
                gone += file.getPath().getName().startswith("part-")
                self._fs.delete(file.getPath(), False)
        return gone


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def op8_tier_compaction(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """Documents arrive in parts by their id; each is appended, and the store is compacted as it grows. The rows of the last version, with the arrival
    that the store keeps beside them and whether compaction left a tier that should have been merged."""
    docs = table(spark, sf_dir, "documents")
    arrival = F.pmod("doc_id", F.lit(arrivals))
    store = Store(spark, shared_dir(spark), f"{DOCUMENTS}, arrival long", target=64 << 20)
    for _ in store.arrivals(docs.withColumn("arrival", arrival), arrival):
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", "arrival", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.lit(store.full_tiers() == 0).alias("compacted"))


OP8_SQL = "SELECT doc_id, lang, source, n_chars, doc_id % 4 AS arrival, sha256(text) AS text_sha256, true AS compacted FROM documents"
