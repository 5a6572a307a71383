"""Bucketed upserts and queue jobs with timers, on small file streams."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confluo.functions import status
from confluo.operators import ranking
from confluo.streaming import buckets, jobs

ROW = "k long, at long, seq long, v string"


def table(spark, tmp_path, **how):
    return buckets.Buckets(spark, f"file://{tmp_path}/t", ROW, ["k"], "at", "seq", **how)


def written(tmp_path):
    return {str(p.parent.relative_to(tmp_path)): p.stat().st_mtime_ns for p in Path(tmp_path, "t", "data").rglob("bucket=*/*.parquet")}


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    assert t.read().count() == 0
    t.upsert(spark.range(100).selectExpr("id AS k", "1L AS at", "id AS seq", "'a' AS v"), 0)
    first = written(tmp_path)
    assert len(first) == 8
    t.upsert(spark.createDataFrame([(5, 2, 0, "b"), (5, 2, 1, "c"), (5, 0, 9, "old")], ROW), 1)
    second = written(tmp_path)
    assert first.items() <= second.items() and len(second) == 9
    assert {r.v for r in t.read().filter("k = 5").collect()} == {"b"} and t.read().count() == 100
    t.upsert(spark.createDataFrame([(5, 1, 0, "late"), (200, 1, 0, "new")], ROW), 2)
    assert sorted((r.k, r.v) for r in t.read().filter("k in (5, 200)").collect()) == [(5, "b"), (200, "new")]
    t.upsert(spark.createDataFrame([], ROW), 3)
    assert t.read().count() == 101


def test_again_and_expired(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2, keep=2)
    batch = lambda n: spark.createDataFrame([(k, n, 0, f"v{n}") for k in range(6)], ROW)
    for n in range(5):
        t.upsert(batch(n), n)
        t.upsert(batch(n), n)
    assert {(r.at, r.v) for r in t.read().collect()} == {(4, "v4")} and t.read().count() == 6
    assert {Path(p).parent.name for p in written(tmp_path)} == {"batch=3", "batch=4"}
    t.upsert(batch(9).withColumn("v", F.lit("again")), 4)  # another run of the last batch takes its place
    assert {r.v for r in t.read().collect()} == {"again"}
    assert t._numbers() == [3, 4]


def test_upsert_stream(spark, tmp_path):
    t, src = table(spark, tmp_path, buckets=4), f"file://{tmp_path}/in"
    for n in range(3):
        spark.createDataFrame([(k, n, 0, f"v{n}") for k in range(n, 10)], ROW).coalesce(1).write.mode("append").parquet(src)
        query = buckets.upsert_stream(spark.readStream.schema(ROW).parquet(src), t, f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(0, "v0"), (1, "v1"), *[(k, "v2") for k in range(2, 10)]]


def test_outcomes_are_those_of_the_columns(spark):
    cases = [(h, m, p, a) for h in (200, 404, 401, 403, 429, 500, None) for m in (True, False) for p in (True, False) for a in (1, 2, 3)]
    df = spark.createDataFrame(cases, "h int, m boolean, p boolean, a int")
    assert [r.x for r in df.select(status.outcome(F.col("h"), F.col("m"), F.col("p"), F.col("a")).alias("x")).collect()] == [jobs.fetched(*c) for c in cases]
    hours = [(s, p) for s in ("done", "unmatched", "deferred", "invalid", "blocked") for p in ("high", "medium", "low", None)]
    due = spark.createDataFrame(hours, "s string, p string").select((F.unix_seconds(status.next_check(F.col("s"), F.col("p"), F.timestamp_seconds(F.lit(0)))) / 3600).alias("x")).collect()
    assert [r.x for r in due] == [jobs.delay_hours(*c) for c in hours]


def test_timers_fire(spark, tmp_path):
    schema, src, seen = "url string, seq long, http int, matched boolean, parsed boolean, priority string", f"file://{tmp_path}/in", []
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
    put(("a", 1, 200, True, True, "high"), ("b", 2, 503, None, None, "low"), ("b", 1, 429, None, None, "low"), ("c", 1, 404, None, None, None))
    out = jobs.job_queue(spark.readStream.schema(schema).parquet(src), ttl_hours=100, hour_ms=100)
    query = out.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="100 milliseconds").start()

    def until(*wanted):
        end = time.time() + 60
        while time.time() < end:
            if all(any(s[: len(w)] == w for s in seen) for w in wanted):
                return
            time.sleep(0.1)
        pytest.fail(f"{wanted} not all in {seen}, {query.exception()}")

    try:
        until(("a", "fetched", "done", 0), ("b", "fetched", "deferred", 2), ("c", "fetched", "invalid", 1))
        assert next(s for s in seen if s[0] == "c")[4] is None
        put(("b", 2, 200, True, True, "low"), ("d", 1, None, None, None, "low"))  # b's was seen
        until(("d", "fetched", "deferred", 1))
        assert not any(s[:3] == ("b", "fetched", "done") for s in seen)
        until(("a", "due", "done"), ("b", "due", "deferred"), ("c", "expired", "invalid"), ("a", "expired", "due"))
    finally:
        query.stop()


def test_latest_by_text_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "0"), (2, None, "x")], "k int, at int, t string")
    assert sorted(tuple(r) for r in ranking.latest(rows, ["k"], "at", "t").collect()) == [(1, 5, "a"), (2, None, "x")]
    same = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    assert sorted(tuple(r) for r in ranking.batch(same, [F.col("k")], 3).collect()) == [(1, True), (1, True), (2, True), (3, False)]
