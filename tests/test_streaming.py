import os

import pytest
from pyspark.sql import functions as F

from storyledger.catalog.queries import QUERIES
from storyledger.functions.urls import with_canonical_url
from storyledger.operators.identity import first_per_key
from storyledger.sources.store import Store
from storyledger.streaming import jobs

ROWS = [(i, f"https://www.x.example.com/{i % 30}?utm_source={i}") for i in range(90)]


def build(batch):
    return with_canonical_url(batch, "url_raw", out="url").withColumn("fetched_at", F.timestamp_seconds("id")).withColumn("source_id", F.lit("s"))


def run(spark, folder, parts):
    frame = spark.createDataFrame(ROWS, "id long, url_raw string")
    frame.repartition(parts, "id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = Store(f"{folder}/store", n=8)
    jobs.stream_ingest(stream, store, f"{folder}/work", build, ("id",)).awaitTermination()
    return sorted(r.url for r in store.read(spark, "raw_documents", None, store.latest(spark)).collect())


def test_batches_do_not_matter(spark, tmp_path):
    one = run(spark, tmp_path / "one", 1)
    many = run(spark, tmp_path / "many", 3)
    assert one == many and len(one) == 30


def test_replay_appends_nothing(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, "id long, url_raw string")
    store = Store(f"{tmp_path}/store", n=8)
    sink = jobs.append_new_documents(store, ("id",), build, f"{tmp_path}/staging")
    sink(frame, 0)
    sink(frame, 0)
    sink(frame, 1)
    stored = store.read(spark, "raw_documents", None, store.latest(spark))
    assert stored.count() == 30
    assert first_per_key(stored, ["url"], F.col("id")).agg(F.max("id")).first()[0] == 29


def test_stream_dedup(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, "id long, url_raw string").withColumn("fetched_at", F.timestamp_seconds("id"))
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = jobs.run_to_table(jobs.dedup_stream(stream, "url_raw").select("url"), f"{tmp_path}/out", f"{tmp_path}/work")
    assert out.count() == 30


def test_dedup_hands_over_to_the_store(spark, tmp_path):
    """Batches a day apart; the last brings a URL of the first back, long after its state has expired."""
    for i in range(6):
        urls = [f"https://x.example.com/{i}-{j}" for j in range(20)] * 2 + (["https://x.example.com/0-3?utm_source=z"] if i == 5 else [])
        rows = spark.createDataFrame([(u, i * 86_400 + j) for j, u in enumerate(urls)], "url_raw string, at long")
        rows.withColumn("fetched_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(tmp_path / "in"):
            if name.startswith("part-") and os.path.getmtime(tmp_path / "in" / name) > 1e9:
                os.utime(tmp_path / "in" / name, (1000 + i, 1000 + i))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = Store(f"{tmp_path}/store", n=4)
    query = jobs.dedup_into_store(stream, "url_raw", store, f"{tmp_path}/work", lateness="1 hour")
    query.awaitTermination()
    got = [r.url for r in store.read(spark, "raw_documents", None, store.latest(spark)).collect()]
    assert len(got) == 120 and len(set(got)) == 120
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 6 and max(held) <= 41


def test_fetch_health_has_open_hours_and_late_rows(spark, tmp_path):
    # An hour in each batch; the last batch brings rows that are ten hours late.
    for i, hours in enumerate(([0, 10], [11], [0, 11])):
        rows = [(h * 3600 + 5, "s", 2, None if h else "http") for h in hours]
        frame = spark.createDataFrame(rows, "at long, source_id string, items_new int, error string")
        frame.withColumn("attempted_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(tmp_path / "in"):
            if name.startswith("part-") and os.path.getmtime(tmp_path / "in" / name) > 1e9:
                os.utime(tmp_path / "in" / name, (1000 + i, 1000 + i))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.fetch_health_table(stream, f"{tmp_path}/out", f"{tmp_path}/work").collect()
    assert {(r.hour.hour, r.attempts, r.items_new, r.errors) for r in got} == {(0, 2, 4, 2), (10, 1, 2, 0), (11, 2, 4, 0)}
    again = jobs.fetch_health_table(stream, f"{tmp_path}/out", f"{tmp_path}/work").collect()
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_dedup", "stream_fetch_health"])
def test_tables_of_many_files_stream(spark, tmp_path, name):
    """A table may be one file or a folder of files; a stream must find the rows of both."""
    events = spark.createDataFrame([(i, 1, "click", 1.0) for i in range(8)], "event_id long, user_id long, event_type string, value double")
    events.withColumn("ts", F.timestamp_seconds("event_id")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    pages = spark.createDataFrame([(i, f"https://x.example.com/{i % 5}") for i in range(8)], "page_id long, url string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.agg(F.sum("attempts")).first()[0] == 8 if name == "stream_fetch_health" else got.count() == 5
