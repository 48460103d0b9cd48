"""Sharding by size-tiered compaction, with DataFrame functions and the file system's API on the driver only.

A store is a folder: runs/ hold Parquet shards that never change, each write in a folder of a random name, and
manifests/v<n>/ hold one version each, a table with a row for each run. Arrivals are appended as runs of small shards. A
run's tier is the logarithm of its bytes; whenever a tier has FANOUT runs, they are merged into one whose shards have the
target size. So a row is written once a tier, and only then.

Data is written where it stays, and nothing reads it before a version names it. A version becomes visible by the rename of
its folder, which fails if the version exists: of two writers one wins, and the other commits its runs on top of
that. A job that dies, wherever, leaves only files that no manifest names. Old runs stay until vacuum(), for readers of older
versions.

Merges read small files packed into partitions of the target size and write them as they are: no shuffle.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of a merged shard, and the runs of one tier that start a merge.
TARGET_BYTES = 128 << 20
FANOUT = 4
#: Runs under this size share tier 0; each further tier is FANOUT times as large.
BASE_BYTES = 4 << 20


@dataclass(frozen=True)
class Run:
    run_id: str
    folder: str
    arrivals: str
    tier: int
    shards: int
    rows: int
    bytes: int
    schema: str


_SCHEMA = "run_id string, folder string, arrivals string, tier int, shards int, rows long, bytes long, schema string"


def _with_files(runs: list[Run]) -> list[Run]:
    """Runs but for those that only hold columns of an empty table."""
    return [r for r in runs if r.shards]


def merged_schema(runs: list[Run]) -> StructType:
    """Columns of all runs, in the order in which they came; ValueError if a name has two types."""
    found: dict[str, StructField] = {}
    for run in runs:
        for field in StructType.fromJson(json.loads(run.schema)).fields:
            known = found.setdefault(field.name.lower(), StructField(field.name, field.dataType, True))
            if known.dataType != field.dataType:
                raise ValueError(f"column {field.name} is {known.dataType.simpleString()} and {field.dataType.simpleString()}")
    return StructType(list(found.values()))


class Store:
    """A sharded table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES):
        if fanout < 2:
            raise ValueError("fanout is 2 at least")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.base_bytes = target_bytes, fanout, base_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("runs", "manifests", "tmp"):
            self._fs.mkdirs(self._path(f"{self.root}/{part}"))

    def _ls(self, folder: str) -> list:
        return list(self._fs.listStatus(self._path(folder)))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base_bytes, self.fanout)) + 1) if size >= self.base_bytes else 0

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()[1:]) for x in self._ls(f"{self.root}/manifests"))

    def manifest(self, version: int | None = None) -> list[Run]:
        """Runs of a version, the newest by default; none before the first commit."""
        if version is None:
            if not (all_versions := self.versions()):
                return []
            version = all_versions[-1]
        rows = self.spark.read.schema(_SCHEMA).json(f"{self.root}/manifests/v{version}").collect()
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: r.run_id)

    def _moved(self, folder: str, to: str) -> bool:
        """Whether a rename took place; some file systems say so by an error."""
        from py4j.protocol import Py4JJavaError

        try:
            return self._fs.rename(self._path(folder), self._path(to))
        except Py4JJavaError:
            return False

    def commit(self, runs: list[Run], version: int) -> None:
        """Make a version visible, all or nothing; FileExistsError if it's there already."""
        tmp, final = f"{self.root}/tmp/{uuid.uuid4().hex}", f"{self.root}/manifests/v{version}"
        rows = F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(r).items()]) for r in runs]))
        (self.spark.range(1).select(rows) if runs else self.spark.createDataFrame([], _SCHEMA)).coalesce(1).write.json(tmp)
        if self._fs.exists(self._path(final)) or not self._moved(tmp, final):
            self._fs.delete(self._path(tmp), True)
            raise FileExistsError(final)
        if self._fs.exists(self._path(f"{final}/{tmp.rpartition('/')[2]}")):  # it came into a folder that another writer made meanwhile
            self._fs.delete(self._path(f"{final}/{tmp.rpartition('/')[2]}"), True)
            raise FileExistsError(final)

    def _described(self, folder: str, arrivals: str, rows: int, schema: StructType) -> Run:
        files = [x for x in self._ls(f"{self.root}/runs/{folder}") if x.getPath().getName().endswith(".parquet")]
        size = sum(x.getLen() for x in files)
        return Run(folder.replace("/", "."), folder, arrivals, self.tier(size), len(files), rows, size, json.dumps(schema.jsonValue()))

    def _committed(self, make) -> bool:
        """Commit make(newest runs) as the next version, again on top of what other writers commit meanwhile; False if it gives None."""
        while True:
            version = (self.versions() or [0])[-1]
            if (runs := make(self.manifest(version) if version else [])) is None:
                return False
            try:
                self.commit(runs, version + 1)
                return True
            except FileExistsError:
                continue

    def append(self, arrivals: DataFrame, by: str) -> list[Run]:
        """One run for each value of column by (a number or null), all in one pass, and a new version with them.

        by goes into the run's description and out of its rows. Each task writes the arrivals that it has, so shards are as
        small as they come. Other columns may differ from those before: rows without a column have null there, and a column
        of another type than before is a ValueError before anything is written. An empty table adds a version but no run; in a store without
        any, the manifest gets one without files that holds the columns.
        """
        schema = StructType([f for f in arrivals.schema.fields if f.name.lower() != by.lower()])
        merged_schema([*self.manifest(), Run("", "", "", 0, 0, 0, 0, json.dumps(schema.jsonValue()))])
        name = uuid.uuid4().hex
        whole = f"{self.root}/runs/{name}"
        arrivals.write.partitionBy(by).parquet(whole)
        found = sorted((x.getPath().getName() for x in self._ls(whole) if x.isDirectory()), key=lambda x: (len(x), x))
        counts = {}
        if found:
            counts = {str(r[by]): r["count"] for r in self.spark.read.parquet(whole).groupBy(by).count().collect()}
        values = [x.partition("=")[2] for x in found]
        made = [self._described(f"{name}/{x}", v, counts.get(v, counts.get("None", 0)), schema) for x, v in zip(found, values)]
        only_columns = [Run(name, "", "", 0, 0, 0, 0, json.dumps(schema.jsonValue()))]
        self._committed(lambda runs: runs + (made or ([] if runs else only_columns)))
        return made

    def _due(self, runs: list[Run]) -> list[Run]:
        """The first FANOUT runs of the lowest tier that has so many."""
        by_tier: dict[int, list[Run]] = {}
        for r in _with_files(runs):
            by_tier.setdefault(r.tier, []).append(r)
        return next((x[: self.fanout] for _, x in sorted(by_tier.items()) if len(x) >= self.fanout), [])

    def _table(self, runs: list[Run]) -> DataFrame:
        schema, folders = merged_schema(runs), [f"{self.root}/runs/{r.folder}" for r in _with_files(runs)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def compact(self, keep_old: bool = True) -> int:
        """Merge until no tier has FANOUT runs; a version for each merge. Returns the number of merges.

        A merge whose runs another writer has merged meanwhile is dropped. Without keep_old, runs go as soon as the version
        without them is visible, so that beside the table itself there is never more than one merge on disk; older versions
        can't be read then.
        """
        merges = 0
        while due := self._due(self.manifest()):
            folder, size = uuid.uuid4().hex, sum(r.bytes for r in due)
            shards = max(1, round(size / self.target_bytes))
            self._table(due).coalesce(shards).write.parquet(f"{self.root}/runs/{folder}")
            schema = merged_schema(due)
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/runs/{folder}").count()
            if rows != sum(r.rows for r in due):
                raise RuntimeError(f"a merge of {sum(r.rows for r in due)} rows has {rows}")
            merged = self._described(folder, ",".join(r.arrivals for r in due), rows, schema)
            # runs that are merged must climb, else shards that pack better would be merged for ever
            merged = replace(merged, tier=max(merged.tier, due[0].tier + 1))
            if self._committed(lambda runs: [r for r in runs if r not in due] + [merged] if all(r in runs for r in due) else None):
                merges += 1
            else:
                self._fs.delete(self._path(f"{self.root}/runs/{folder}"), True)
            if not keep_old:
                self.vacuum()
        return merges

    def vacuum(self) -> int:
        """Delete runs that an older version names and the newest doesn't; returns their number.

        Runs that no version names are left alone, as another writer may be about to commit them.
        """
        versions = self.versions()
        if len(versions) < 2:
            return 0
        live = {r.folder for r in self.manifest(versions[-1])}
        older = self.spark.read.schema(_SCHEMA).json([f"{self.root}/manifests/v{v}" for v in versions[:-1]])
        dead = [r.folder for r in older.select("folder").distinct().collect() if r.folder not in live]
        return sum(bool(self._fs.delete(self._path(f"{self.root}/runs/{x}"), True)) for x in dead)

    def pending(self) -> int:
        """Number of merges that are due at once: full groups of FANOUT runs of one tier."""
        return sum(n // self.fanout for n in Counter(r.tier for r in _with_files(self.manifest())).values())

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the columns of all its runs, null where a run lacks one; ValueError before the first append."""
        if not (runs := self.manifest(version)):
            raise ValueError("no runs")
        return self._table(runs)

    def read(self, version: int | None = None) -> DataFrame:
        """As rows(), with run_id and tier, which replace columns of these names whatever their case."""
        if not (runs := self.manifest(version)):
            raise ValueError("no runs")
        frame = self._table(runs)
        kept = [F.col(f"`{c}`") for c in frame.columns if c.lower() not in ("run_id", "tier")]
        if not (runs := _with_files(runs)):
            return frame.select(*kept, F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("int").alias("tier"))
        place = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/(.+)/[^/]+$", 1)
        known = lambda of: F.element_at(F.create_map(*[F.lit(x) for r in runs for x in (r.folder, of(r))]), place)
        return frame.select(*kept, known(lambda r: r.run_id).alias("run_id"), known(lambda r: r.tier).alias("tier"))
