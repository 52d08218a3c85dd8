"""Exact deduplication with state that never expires.

A stream reads the table in micro-batches. Its keyed state (RocksDB: on local disk, uploaded to the
checkpoint folder) holds, for each digest of a text, how many rows had it, the stable identifier of the
row that stays and the locator of that row's content (file and row in the file). It needs no watermark, so a copy
of a text seen years ago is found. The texts of digests that were hit are then compared in full: equal
digests count as equal texts only if the smallest and the largest text of the digest are the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.session import landed, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# 200 000 hex digests stay under 20 MB.
MAX_BROADCAST_HITS = 200_000
BYTES_PER_BATCH = 256 << 20  # of files read into the state at once; a large cluster takes more
MAX_FILE_AGE = "36500d"  # a stream would else leave out files much older than the newest it has seen
STATE_SCHEMA = "digest string, n bigint, last struct<id: bigint, file: string, row: bigint>, batch int"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(df: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Identifier, content locator, whole text (null: empty) and digest of rows of a file source."""
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.struct(
            F.col(key).cast("bigint").alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("last"),
        content.alias("content"),
        digest(content).alias("digest"),
    )


def absorb(
    spark: SparkSession,
    path: str,
    folder: str,
    *,
    key: str,
    text: str,
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """Stream new files of ``path`` into the state kept in ``folder``; the whole state as a frame.

    A second call with the same folder reads only files that came since, however old they are. Files are read in
    batches of about ``bytes_per_batch``; later ones find the digests of earlier ones in the state. A batch that is
    run again after a failure overwrites its own changes.
    """
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", bytes_per_batch).option("maxFileAge", MAX_FILE_AGE)
    parent, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:
        source = reader.option("pathGlobFilter", name).parquet(parent)  # a stream reads folders: the one the file is in
    else:
        source = reader.parquet(path)
    counts = (
        located(source, key, text, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    )
    changes = f"{folder}/changes"
    empty = spark.createDataFrame([], STATE_SCHEMA).drop("batch")
    empty.write.mode("overwrite").parquet(f"{changes}/batch=-1")

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{changes}/batch={batch}")

    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # No space is reserved ahead for each of many state partitions; changes are uploaded, not whole copies.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        query = (
            counts.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    # Counts only grow, and so does the last row: the largest of all changes is the present state.
    logged = spark.read.schema(STATE_SCHEMA).parquet(changes)
    return logged.groupBy("digest").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def collided(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests that stand for more than one text.

    Only digests with several rows are looked at. Copies of one text fold to one before the shuffle,
    however many there are.
    """
    hits = state.where("n > 1").select("digest")
    some = rows
    if hits.limit(MAX_BROADCAST_HITS + 1).count() <= MAX_BROADCAST_HITS:
        some = rows.join(F.broadcast(hits), "digest", "left_semi")
    spans = some.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    return spans.where("low <> high").select("digest")


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """One row for each row of the Parquet table at ``path``: which of its equals stays.

    Returns ``id``, ``keep_id`` (largest identifier among rows with the same text), ``n`` (rows with that
    text), ``kept`` and ``sha256``. Null texts equal empty ones. Of rows that share the largest identifier
    and the text, the one furthest on in the files stays; a null identifier counts as the smallest. An
    empty table gives no rows. Other columns are never read.
    """
    folder = folder or work_dir(spark, "exact-dedup")
    state = landed(
        absorb(spark, path, folder, key=key, text=text, digest=digest, bytes_per_batch=bytes_per_batch), "digests"
    )
    rows = located(spark.read.parquet(path), key, text, digest)
    mixed = landed(collided(rows, state), "collisions")
    out = rows.select("last", "digest", sha256(F.col("content")).alias("sha256"))
    kept = state.withColumnRenamed("last", "keep")
    if not mixed.isEmpty():
        # One digest, several texts: those rows are grouped by the texts themselves.
        clash = rows.join(mixed, "digest", "left_semi")
        exact = clash.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("keep"))
        apart = clash.join(exact, ["digest", "content"]).select("last", sha256(F.col("content")).alias("sha256"), "n", "keep")
        out = out.join(mixed, "digest", "left_anti")
        joined = out.join(kept, "digest", "left").select("last", "sha256", "n", "keep").unionByName(apart)
    else:
        joined = out.join(kept, "digest", "left")
    lost = F.raise_error(F.lit("exact dedup: a row's digest is not in the state")).cast("bigint")
    joined = joined.withColumn("n", F.coalesce("n", lost))
    return joined.select(
        F.col("last.id").alias("id"),
        F.col("keep.id").alias("keep_id"),
        "n",
        (F.col("last") == F.col("keep")).alias("kept"),
        "sha256",
    )
