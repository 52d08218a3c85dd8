"""Stored tables that grow by batches, and a URL index of which a batch opens only its own buckets.

Every batch is a version. Its rows go to folders of that version, and the version counts once its manifest is
written, last of all. A batch that is run again overwrites its own folders and nothing else, and one whose manifest
stands is not run again: readers see all tables of a batch or none.

``appended`` tables add rows with each version, ``replaced`` ones are small and written whole. The URLs of stored documents
are indexed on their own, in ``n`` buckets by hash. Each version adds a run to the buckets that it has URLs for;
``fanout`` runs of one level merge into one of the next, so a bucket has few runs however many versions there
are. The manifest lists the live runs: a batch reads those of its own buckets and no other file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.sources.tables import PARTITION_COLUMN

N_BUCKETS = 64
FANOUT = 4
MANIFEST = "bucket int, run int, level int"

Runs = dict[int, list[tuple[int, int]]]  # (run, level) of each bucket, oldest first


@dataclass(frozen=True)
class Store:
    """A folder of versioned tables. ``n`` and ``fanout`` must stay as they were at the first version."""

    root: str
    n: int = N_BUCKETS
    fanout: int = FANOUT

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.n)).cast("int")

    def versions(self, spark: SparkSession) -> DataFrame:
        """``version`` of all that are complete."""
        rows = _parquet(spark, [f"{self.root}/manifest"], f"{MANIFEST}, version int")
        return rows.select("version").distinct()

    def latest(self, spark: SparkSession) -> int:
        """The last complete version; -1 before the first."""
        found = self.versions(spark).agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def runs(self, spark: SparkSession, version: int) -> Runs | None:
        """Live runs of a version, at most a few for each bucket; None if it is not complete."""
        if version < 0:
            return {}
        found: Runs = defaultdict(list)
        rows = _parquet(spark, [f"{self.root}/manifest/version={version}"], MANIFEST).collect()
        for row in sorted(rows):
            found[row.bucket].append((row.run, row.level))
        return dict(found) if rows else None

    def read(self, spark: SparkSession, table: str, schema: str | None, version: int) -> DataFrame:
        """Rows of an appended table up to ``version``, with that as a column that prunes folders."""
        declared = schema and f"{schema}, version int"
        return _parquet(spark, [f"{self.root}/{table}"], declared).where(F.col("version") <= version)

    def read_whole(self, spark: SparkSession, table: str, version: int) -> DataFrame:
        """A replaced table as of ``version``."""
        return spark.read.parquet(f"{self.root}/{table}/version={version}")

    def held(self, spark: SparkSession, urls: DataFrame, version: int) -> DataFrame:
        """Stored URLs of the buckets that ``urls`` (``url``) falls into; reads no other bucket."""
        wanted = [r[0] for r in urls.select(self.bucket(F.col("url"))).distinct().collect()]  # at most ``n``
        live = self.runs(spark, version) or {}
        paths = [f"{self.root}/urls/run={run}/bucket={b}" for b in wanted for run, _ in live.get(b, [])]
        return spark.read.schema("url string").parquet(*paths) if paths else spark.createDataFrame([], "url string")

    def commit(
        self, spark: SparkSession, version: int, urls: DataFrame, appended: Mapping[str, DataFrame], replaced: Mapping[str, DataFrame]
    ) -> None:
        """Write a version after ``version - 1``, its manifest last. The frames should be stored, as each may be read twice."""
        for name, frame in appended.items():
            writer = frame.write.mode("overwrite")
            if name in PARTITION_COLUMN:
                writer = writer.partitionBy(PARTITION_COLUMN[name])
            writer.parquet(f"{self.root}/{name}/version={version}")
        for name, frame in replaced.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        live = self._add_run(spark, version, urls)
        rows = [(b, run, level) for b, runs in live.items() for run, level in runs] or [(-1, -1, -1)]
        manifest = spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")

    def _add_run(self, spark: SparkSession, version: int, urls: DataFrame) -> Runs:
        """Write the URLs of a version and merge full levels; the live runs after that."""
        live = {b: list(runs) for b, runs in (self.runs(spark, version - 1) or {}).items()}
        placed = urls.select("url", self.bucket(F.col("url")).alias("bucket"))
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]
        merged: list[str] = []
        for b in touched:
            runs, level = live.setdefault(b, []), 0
            while len(tail := [r for r, at in runs if at == level]) >= self.fanout - 1:
                merged += [f"{self.root}/urls/run={r}/bucket={b}" for r in tail]
                live[b] = runs = [(r, at) for r, at in runs if at != level]
                level += 1
            runs.append((version, level))
        if merged:
            older = spark.read.schema("url string").parquet(*merged)
            placed = placed.unionByName(older.withColumn("bucket", self.bucket(F.col("url"))))
        dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "url")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/urls/run={version}")
        return live


def _parquet(spark: SparkSession, paths: list[str], schema: str | None) -> DataFrame:
    """A Parquet folder; an empty frame while nothing is there."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)
