"""Scans that fail by source, and the store of responses."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confluo.sources import evidence, scan

PAGES = "source_id long, page long, url string, parser_id string, body string"
SOURCES = "seq long, source_id long, name string, skipped string"


def numbers(body, url):
    for x in body.split(","):
        yield {"n_found": int(x), "of": {"url": url}}


def shapeless(body, url):
    return [{"n_found": "many"}]


def run(spark, sources, pages):
    own = [spark.createDataFrame(sources, SOURCES), spark.createDataFrame(pages, PAGES).repartition(3)]
    return scan.scan(*own, {"numbers": numbers, "shapeless": shapeless}, "n_found long, of struct<url: string, more: array<int>>")


def test_one_source_fails_no_other(spark):
    sources = [(0, 10, "good", None), (1, 11, "one bad page", None), (2, 12, "no key", "no key"), (3, 13, "no pages", None), (4, 14, "shape", None), (5, 15, "null body", None), (6, 16, "parser", None)]
    pages = [(10, 0, "a", "numbers", "1,2"), (10, 1, "b", "numbers", "3"), (11, 1, "d", "numbers", "x"), (11, 0, "c", "numbers", "1"), (11, 2, "e", "numbers", "y"), (12, 0, "f", "numbers", "z"), (14, 0, "g", "shapeless", "1"), (15, 0, "h", "numbers", None), (16, 0, "i", None, "1"), (99, 0, "j", "numbers", "1")]
    records, results, told = run(spark, sources, pages)
    assert sorted((r.source_id, r.page, r.n, r.n_found, r.of.url) for r in records.collect()) == [(10, 0, 0, 1, "a"), (10, 0, 1, 2, "a"), (10, 1, 0, 3, "b")]
    got = {r.source_id: (r.status, r.record_count, r.reason) for r in results.collect()}
    assert got == {10: ("ok", 3, None), 11: ("failed", 0, None), 12: ("skipped", 0, "no key"), 13: ("ok", 0, None), 14: ("failed", 0, None), 15: ("failed", 0, None), 16: ("failed", 0, None)}
    errors = {r.source_id: r.error for r in results.filter("error is not null").collect()}
    assert "'x'" in errors[11] and errors[15].startswith("AttributeError") and errors[16] == "LookupError: no parser None" and set(errors) == {11, 14, 15, 16}
    assert told.filter("source_id = 11").select(F.sum("output_count")).first()[0] == 1 and told.count() == 8
    assert scan.refuse_if_all_failed(results).count() == 7


def test_refused_if_none_was_read(spark):
    _, results, _ = run(spark, [(0, 10, "bad", None), (1, 12, "no key", "no key")], [(10, 0, "a", "numbers", "x")])
    with pytest.raises(ValueError, match="no source"):
        scan.refuse_if_all_failed(results)


def rows(spark, *own):
    base = {"source_id": "a b", "batch_id": "b1", "source_role": "venue_detail", "parser_ids": ["p"], "parser_version": "1", "requested_url": "https://x/1", "attempt": 1, "http_status": 200, "content_type": "text/html", "fetched_at": "2026-06-01"}
    return spark.createDataFrame([base | r for r in own], evidence.RESPONSE)


def files(folder):
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_written_once(spark, tmp_path):
    store = evidence.EvidenceStore(spark, f"file://{tmp_path}")
    batch = rows(spark, {"body": b"one"}, {"body": b"one", "attempt": 2}, {"body": b"two", "http_status": 404}, {"error": "timeout", "attempt": 3}, {"error": "timeout", "attempt": 3})
    store.add(batch)
    first = files(tmp_path)
    store.add(batch)
    store.add(batch.limit(2))
    assert files(tmp_path) == first
    assert sorted(bytes(r.body) for r in store.bodies().collect()) == [b"one", b"two"]
    entries = store.entries()
    assert sorted((r.fetch_status, r.attempt) for r in entries.collect()) == [("http_error", 1), ("page_fetch_failed", 3), ("success", 1), ("success", 2)]
    failed = entries.filter("fetch_status = 'page_fetch_failed'").first()
    assert failed.canonical_url is None and failed.content_hash is None and failed.parser_errors == ["timeout"] and failed.entry.endswith(".fetch-failed")
    store.add(rows(spark, {"body": b"one", "batch_id": "b2"}, {"body": b"three"}))
    after = files(tmp_path)
    assert first.items() <= after.items() and len(after) > len(first)
    assert store.bodies().count() == 3 and store.entries().count() == 6
    new = files(tmp_path)
    store._append(store.bodies().filter("content_hash is null").withColumn("bucket", F.lit("0")), "bodies", ["content_hash"])
    assert files(tmp_path) == new
    store.bodies().limit(1).withColumn("bucket", F.lit("0")).write.mode("append").partitionBy("bucket").parquet(f"{store.root}/bodies")  # another writer at the same time
    assert store.bodies().count() == 3


def test_rules_of_manifests(spark, tmp_path):
    store = evidence.EvidenceStore(spark, f"file://{tmp_path}")
    store.add(rows(spark, {"body": b"one"}, {"body": b"two", "source_id": "b", "content_type": None}, {"error": "x", "source_role": None}, {"body": b"", "source_id": "c"}))
    bodies = store.bodies().withColumn("body", F.when(F.col("body") == F.lit(b"one"), F.lit(b"other")).otherwise(F.col("body")))
    results = spark.createDataFrame([(1, "a b", "https://x/1", "p", "parser_failed", "late", 0), (2, "a b", "https://x/1", "p", "success", None, 4), (3, "a b", "https://x/1", "q", "success", "late", 1)], "seq int, source_id string, url string, parser_id string, status string, error string, output_count int")
    entries = evidence.with_parser_results(store.entries(), results)
    assert {(r.source_id, r.rule) for r in evidence.incomplete(entries, bodies, ["venue_detail"]).collect()} == {("a b", "body changed"), ("a b", "metadata"), ("b", "response"), ("b", "parser not recorded"), ("c", "parser not recorded")}
    said = entries.filter("source_id = 'a b' and content_hash is not null").first()
    assert (said.parser_status, said.output_count, said.parser_errors) == ("success", 1, ["p: late", "q: late"])
    assert {(r.source_id, r.url) for r in evidence.latest_success(entries).collect()} == {("a b", "https://x/1"), ("b", "https://x/1"), ("c", "https://x/1")}
    assert evidence.incomplete(entries, bodies.filter("false"), ["venue_detail"]).filter("rule = 'body missing'").count() == 2
