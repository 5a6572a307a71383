"""Cases of enrichment that the queries' rows do not have."""

from pyspark.sql import functions as F

from confluo.sources import enrich

TICKETS, FEES, RULES = "array<struct<name:string,price_jpy:bigint>>", "array<struct<type:string,amount_jpy:bigint>>", "array<struct<label:string>>"
LISTS = f"ticket_types {TICKETS}, prices_jpy array<bigint>, additional_fees {FEES}, eligibility {RULES}, purchase_urls array<string>"
LISTED = ", ".join(f"{c} {t}" for c, t in enrich.LISTED.items()) + f", {LISTS}, content_hash string, fetched_at string"
DETAIL = ", ".join(f"{c} {t}" for c, t in enrich.DETAIL.items()) + f", {LISTS}, seq int"


def listed(spark, **row):
    base = {"source_url": "u", "field_availability": {"title": "published"}, "content_hash": "old", "fetched_at": "t0"}
    return spark.createDataFrame([base | row], LISTED)


def page(spark, *rows):
    base = {"url": "u", "ok": True, "seq": 1}
    return spark.createDataFrame([base | r for r in rows], DETAIL)


def one(df):
    return df.collect()[0].asDict(recursive=True)


def test_times_only_where_unambiguous(spark):
    def times(row, **detail):
        r = one(enrich.enrich(listed(spark, **row), page(spark, detail), enrich.hall("h")))
        return r["open_time"], r["start_time"]

    two = {"open_times": ["12:00", "17:00"], "start_times": ["13:00", "18:00"]}
    assert times({}, open_times=["17:00"], start_times=["18:00"]) == ("17:00", "18:00")
    assert times({}, **two) == (None, None)
    assert times({"start_time": "18:00"}, **two) == ("17:00", "18:00")
    assert times({"start_time": "19:00"}, **two) == (None, "19:00")
    assert times({"start_time": "19:00"}, open_times=["17:00"], start_times=["18:00"]) == ("17:00", "19:00")
    assert times({"start_time": "18:00"}, open_times=["12:00"], start_times=["13:00", "18:00"]) == (None, "18:00")
    assert times({"open_time": "10:00", "start_time": "11:00"}, **two) == ("10:00", "11:00")


def test_null_lists_and_no_page(spark):
    row = listed(spark, source_url="elsewhere")
    assert one(enrich.enrich(row, page(spark, {}), enrich.hall("h"))) == one(row)
    r = one(enrich.enrich(listed(spark, field_availability=None), page(spark, {"ok": False, "reason": None}), enrich.hall("h")))
    assert r["parser_errors"] == ["zepp-detail: "] and set(r["field_availability"].values()) == {"parser_failed"} and r["ticket_types"] is None
    r = one(enrich.enrich(listed(spark, purchase_urls=["a", "a"]), page(spark, {"ok": None, "availability": "page_fetch_failed", "purchase_urls": ["b"], "links": [("x", "y")]}), enrich.arena("h")))
    assert r["purchase_urls"] == ["a", "b"] and r["field_availability"]["purchaseUrls"] == "published" and [x["url"] for x in r["source_chain"]] == ["u", "y"]
    assert enrich.enrich(listed(spark, source_url=None), page(spark, {"url": None}), enrich.hall("h")).count() == 1


def test_last_page_counts_and_hash(spark):
    pages = page(spark, {"seq": 2, "prices_jpy": [5]}, {"seq": 3, "prices_jpy": [7]}, {"seq": 1, "prices_jpy": [6]})
    r = one(enrich.enrich(listed(spark, prices_jpy=[1]), pages, enrich.hall("h")))
    assert r["prices_jpy"] == [7] and r["field_availability"]["prices"] == "published"
    again = one(enrich.enrich(listed(spark, prices_jpy=[1], fetched_at="later", content_hash="other"), pages, enrich.hall("h")))
    assert again["content_hash"] == r["content_hash"] != "old"
    other = one(enrich.enrich(listed(spark, prices_jpy=[1], ticket_url="z", open_time="09:00"), pages, enrich.hall("h")))
    assert other["content_hash"] != r["content_hash"]


def test_pages_to_read_and_results(spark):
    rows = listed(spark).union(listed(spark)).union(listed(spark, source_url="https://a/event/detail/1")).union(listed(spark, source_url=None))
    assert sorted(r.url for r in enrich.detail_urls(rows).collect()) == ["https://a/event/detail/1", "u"]
    assert [r.url for r in enrich.detail_urls(rows, "/event/detail/").collect()] == ["https://a/event/detail/1"]
    pages = page(spark, {"reason": "x"}, {"ok": False, "reason": "r"}, {"ok": False, "availability": "page_fetch_failed", "reason": "t"})
    got = [(r.status, r.error, r.output_count) for r in enrich.parser_results(pages, "p").orderBy(F.desc("output_count"), "error").collect()]
    assert got == [("success", None, 1), ("parser_failed", "r", 0), ("not_run", "t", 0)]
