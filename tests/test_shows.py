"""Pages of shows and texts of prices, with odd markup."""

import pytest
from pyspark.sql import functions as F

from confluo.functions import text
from confluo.sources import shows


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "a string").select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "types"),
    [
        ("[前] ¥1,000 後 / ¥900", [("前", 1000), ("後", 900)]), ("a：¥10 b ／ ￥20 a：¥10", [("a", 10), ("b", 20)]), ("PRICE 一般 / ¥5", [("一般", 5)]), ("¥7 ¥8", [(None, 7)]), ("x / ¥,", [("x", 0)]), ("[ ] ¥3", [(None, 3)]), (None, []), ("", []),
    ],
)
def test_ticket_types(spark, raw, types):
    assert [tuple(r) for r in one(spark, text.ticket_types(F.col("a")), raw)] == types


@pytest.mark.parametrize(("raw", "fee"), [("ドリンク代別途必要", [None]), ("別途ドリンク代 ¥ 650", [650]), ("drink 500", [500]), ("飲み物なし", []), (None, [])])
def test_additional_fees(spark, raw, fee):
    assert [r["amount_jpy"] for r in one(spark, text.additional_fees(F.col("a")), raw)] == fee


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://v.example/a/b", h, "own") for i, h in enumerate(html)], "id int, url string, html string, source string")


def test_details_of_odd_pages(spark):
    cut = '<div class="sch-single-headelin-ttl">T<table class="sch-single-table"><a href="c?x=1">l</a><dl><dt>公式サイト<dd><a href="//w.example/">w</a></dl>'
    rows = {r["id"]: r for r in shows.details(pages(spark, None, "", cut, "x" * 200_000)).collect()}
    assert [rows[i]["ok"] for i in range(4)] == [False, False, True, False] and all(rows[i]["reason"] for i in (0, 1, 3))
    assert [tuple(x) for x in rows[2]["links"]] == [("artist_official", "https://w.example/")]
    assert rows[2]["source"] == "own" and rows[2]["ticket_types"] == [] and rows[2]["prices"] == [] and rows[0]["ticket_types"] is None


def test_tours_of_odd_pages(spark):
    good = "<blockquote><div><p>2/ 28 (土) OPEN 17:00 / START 18:00 <strong>福岡 X<b>Y</b></strong></p></div></blockquote>"
    found = shows.tour_shows(pages(spark, None, "", good, good.replace("28", "30"), good + good), shows.QUOTED_TOUR, "quoted_shows").collect()
    assert sorted((r["id"], r["date"], r["venue_name"]) for r in found) == [(2, "2026-02-28", "XY"), (4, "2026-02-28", "XY"), (4, "2026-02-28", "XY")]
    assert found[0]["ticket_types"][2]["notes"] and found[0]["prices"] == [9900]
    listed = '<ul class="sched-list"><li><i class="sched-date">2026.01.02</i><i class="sched-venue">V\u200b</i></li></ul>'
    only = shows.tour_shows(pages(spark, listed, listed.replace("sched-list", "list")), shows.LISTED_TOUR, "listed_shows").collect()
    assert [(r["id"], r["source_event_id"], r["ticket_phases"][3]["url"], r["purchase_urls"][2]) for r in only] == [(0, "2026-01-02|V", "https://v.example/a/b", "https://v.example/a/b")]
    assert shows.tour_shows(pages(spark, "").limit(0), shows.LISTED_TOUR, "listed_shows").count() == 0
