"""Structured Streaming jobs: ingestion, identity dedup and poll health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyledger.functions.urls import with_canonical_url
from storyledger.limits import NO_LIMITS, Limits
from storyledger.operators.merge import insert_if_absent
from storyledger.plans import bookkeeping
from storyledger.session import landed
from storyledger.sources.store import Store


def append_new_documents(
    store: Store, order: tuple[str, ...], build: Callable[[DataFrame], DataFrame], staging: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends the documents of a batch whose URL is not held.

    The batch is built once into ``staging`` (a shared folder), which is overwritten on replay,
    so that nothing is recomputed when an executor is lost. Of the store's URL index only the buckets
    of the batch are read. A replayed batch whose version is complete appends nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.runs(spark, batch_id) is not None:
            return
        folder = f"{staging}/batch={batch_id}"
        build(batch).write.mode("overwrite").parquet(folder)
        built = spark.read.parquet(folder)
        held = store.held(spark, built, batch_id - 1)
        rows = landed(insert_if_absent(built, held, *order, small_batch=True), "new-documents")
        if "fetch_date" not in rows.columns:
            rows = rows.withColumn("fetch_date", F.to_date("fetched_at"))
        store.commit(spark, batch_id, rows.select("url"), {"raw_documents": rows}, {})

    return sink


def stored(spark: SparkSession, store: str, like: DataFrame) -> DataFrame:
    """The stored documents, or an empty frame before the first batch."""
    try:
        return spark.read.parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def stream_ingest(
    stream: DataFrame,
    store: Store,
    work: str,
    build: Callable[[DataFrame], DataFrame],
    order: tuple[str, ...] = ("fetched_at", "source_id", "url_raw"),
) -> StreamingQuery:
    """Run landed rows through ``build`` into a document store, each URL once."""
    sink = append_new_documents(store, order, build, f"{work}/staging")
    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def stream_bookkeeping(
    stream: DataFrame, store: Store, pages: DataFrame, work: str, limits: Limits = NO_LIMITS
) -> StreamingQuery:
    """Settle landed payloads into a store that ``bookkeeping.found`` began, a version for each batch.

    All tables of a batch count at once, with its manifest. A batch that is replayed after that changes nothing;
    one that failed before it is written again in full.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Read several times, and the files of a batch should be parsed from one copy.
        folder = f"{work}/staging/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        bookkeeping.settle_into(spark, store, batch_id + 1, spark.read.schema(batch.schema).parquet(folder), pages, limits)

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(
    stream: DataFrame, url_col: str, at: str = "fetched_at", lateness: str = "10 days"
) -> DataFrame:
    """Drop repeats of a canonical URL within the watermark; unusable URLs drop out.

    State is bounded by the watermark, so the merge stays the authority on what is held.
    """
    known = with_canonical_url(stream, url_col, out="url").filter(F.col("url").isNotNull())
    return known.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["url"])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def dedup_into_store(
    stream: DataFrame, url_col: str, store: Store, work: str, *, at: str = "fetched_at", lateness: str = "1 day"
) -> StreamingQuery:
    """Append the first row of every canonical URL of a stream to a store, once for all time.

    Repeats within ``lateness`` are dropped by keyed state on the executors' disks (RocksDB), each URL with its own
    expiry. What the state has let go is in the store by then, and its URL index drops later repeats. So
    the state holds the URLs of the lateness and no more, however long the stream runs.
    """
    spark = stream.sparkSession
    unique = dedup_stream(stream, url_col, at, lateness)
    sink = append_new_documents(store, (at, "url"), lambda batch: batch, f"{work}/staging")
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        return (
            unique.writeStream.foreachBatch(sink)
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(STATE_PROVIDER) if before is None else spark.conf.set(STATE_PROVIDER, before)


def hourly_fetch_health(log: DataFrame, at: str = "attempted_at", lateness: str = "1 hour") -> DataFrame:
    """Attempts, new items and errors per source and hour; works on a stream and on a table."""
    return (
        log.withWatermark(at, lateness)
        .groupBy(F.window(at, "1 hour").alias("hour"), "source_id")
        .agg(
            F.count("*").alias("attempts"),
            F.sum("items_new").alias("items_new"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
        )
        .select(F.col("hour")["start"].alias("hour"), "source_id", "attempts", "items_new", "errors")
    )


def fetch_health_table(stream: DataFrame, folder: str, work: str) -> DataFrame:
    """``hourly_fetch_health`` over all that is available now, with open hours and late rows.

    Each batch writes its partial counts of an hour and source; a replayed batch overwrites its own. The counts of
    an hour are summed on reading, so no hour waits for a watermark and no row comes too late to count.
    """
    keys = ["hour", "source_id"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        hourly_fetch_health(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    none = stream.sparkSession.createDataFrame([], hourly_fetch_health(stream).schema)
    parts = stored(stream.sparkSession, folder, none)
    sums = [F.sum(c).alias(c) for c in ("attempts", "items_new", "errors")]
    return parts.groupBy(*keys).agg(*sums)


def run_to_table(stream: DataFrame, folder: str, work: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a Parquet folder and read that back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", folder)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
