import pytest
from pyspark.sql import functions as F

from confluo.functions import clock, geometry, status, text, urls
from confluo.sources import calendar


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "names"),
    [
        ("First 【Guest】Second / Third", ["First", "Second", "Third"]), ("Rock and Roll Group with guest Solo", ["Rock", "Roll Group with", "Solo"]), ("One Act →出演キャンセルのお知らせ", []), ("A × B、C, D", ["A", "B", "C", "D"]), ("出演者：ZZ / ZZ", ["ZZ"]), ("", []), (None, []), ("【東京：甲 / 乙】", ["甲", "乙"]),
        ("【DAY 3】甲 / 乙 ほか", ["甲", "乙"]), ("DAY2 - 甲、乙", ["甲", "乙"]), ("甲（Guitar）) / 乙", ["甲", "乙"]), ("甲 / VJ：乙", ["甲"]), ("甲 / 新宿LOFT / Zepp Somewhere", ["甲"]), ("甲 w / 乙", ["甲", "乙"]), ("ハロプロ研修生東北 / 甲", ["ハロプロ研修生", "東北", "甲"]),
    ],
)
def test_split_names(spark, raw, names):
    assert one(spark, text.split_names(F.col("a")), a=raw) == names


def test_names(spark):
    assert one(spark, text.normalize_name(F.col("a")), a=" ＹＯＡ　ＳＯＢＩ（仮）") == "yoasobi仮"
    assert one(spark, text.fold_japanese(F.col("a")), a="スーパー") == one(spark, text.fold_japanese(F.col("a")), a="すーぱー") == "すぱ"
    assert one(spark, text.clean_text(F.col("a")), a="​ a  　 b\n") == "a b"


@pytest.mark.parametrize(
    ("raw", "prices", "n", "tax", "fee"),
    [
        ("当日券 ￥3,210", [3210], 1, None, None), ("[席] Aブロック / ¥1,100 Bブロック / ¥2,200", [1100, 2200], 2, None, None), ("[前方] ¥7,000 [後方] ¥5,000 [立見] ¥3,000", [3000, 5000, 7000], 3, None, None), ("全席 / ¥4,321（税込）", [4321], 1, True, None), ("立見 / ¥2,000（税抜）", [2000], 1, False, None),
        ("立見 / ¥2,500（税込） ドリンク代 ¥700 別", [700, 2500], 1, True, 700), ("無料", [], 0, None, None),
    ],
)
def test_ticket_text(spark, raw, prices, n, tax, fee):
    assert one(spark, text.yen_prices(F.col("a")), a=raw) == prices
    assert len(one(spark, text.ticket_types(F.col("a")), a=raw)) == n
    assert one(spark, text.tax_included(F.col("a")), a=raw) is tax and one(spark, text.drink_fee(F.col("a")), a=raw) == fee


def test_similarity(spark):
    sim = text.title_similarity(F.col("a"), F.col("b"))
    assert one(spark, sim, a="abc", b="abc") == 1 and one(spark, sim, a="", b="abc") == 0 and one(spark, sim, a="abcd", b="abce") == 0.5 and one(spark, sim, a="a", b="b") == 0
    over = text.overlap_score(F.col("a"), F.col("b"))
    assert one(spark, over, a="abcd", b="ab") == 0.5 and one(spark, over, a="abc", b="bcd") == pytest.approx(2 / 3) and one(spark, over, a="", b="x") == 0


def test_visible_text(spark):
    page = "<script>var a='</p>'</script><STYLE>p{}</STYLE><p>a&nbsp;b <b>c</b>&amp;d</p>"
    assert one(spark, text.visible_text(F.col("a")), a=page) == "a b c d"


@pytest.mark.parametrize(
    ("url", "canonical", "kind"),
    [
        ("HTTPS://EPLUS.JP/sf/detail/123/?utm_source=x&b=2&a=1#top", "https://eplus.jp/sf/detail/123?a=1&b=2", "event_detail"), ("https://eplus.jp/sf/word/1", "https://eplus.jp/sf/word/1", "generic_provider"),
        ("https://t.pia.jp/pia/event/event.do?eventCd=99", "https://t.pia.jp/pia/event/event.do?eventCd=99", "event_detail"), ("https://l-tike.com/mevent/?mid=5", "https://l-tike.com/mevent?mid=5", "event_detail"),
        ("https://l-tike.com/search/?keyword=x", "https://l-tike.com/search?keyword=x", "search"), ("https://x.jp/help/", "https://x.jp/help", "support"), ("https://x.jp/refund2.html", "https://x.jp/refund2.html", "refund"), ("https://x.jp", "https://x.jp/", "unknown"), ("ftp://x.jp/a", None, "unknown"), ("nothing", None, "unknown"),
    ],
)
def test_urls(spark, url, canonical, kind):
    assert one(spark, urls.canonical(F.col("a")), a=url) == canonical
    assert one(spark, urls.kind(F.col("a")), a=url) == kind
    again = urls.canonical(urls.canonical(F.col("a")))
    assert one(spark, again, a=url) == canonical


def test_provider_ids(spark):
    assert one(spark, urls.provider_event_id(F.col("a")), a="https://eplus.jp/sf/detail/123") == "123"
    assert one(spark, urls.offer_id(F.lit("e1"), F.col("a")), a="https://t.pia.jp/pia/event/event.do?eventCd=9") == "offer:pia:9"
    assert one(spark, urls.offer_id(F.lit("e1"), F.col("a")), a="https://x.jp/a") == "offer:e1:other:https%3A%2F%2Fx.jp%2Fa"
    assert one(spark, urls.canonical_social(F.col("a")), a="https://me:pw@x.com/a") is None
    assert one(spark, urls.canonical_social(F.col("a")), a="https://x.com/a?access_token=1&SI=3&utm_any=4&b=2&token=5") == "https://x.com/a?b=2&token=5"


def test_status(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    now = at("2026-08-01 00:00:00")
    sale = lambda s, a, b: one(spark, status.sale_status(F.lit(s), at(a), at(b), now))
    assert [sale("open", None, "2026-07-31"), sale("closed", "2026-09-01", None), sale("x", "2026-08-02", None), sale("x", "2026-07-01", None), sale("x", None, "2026-09-01")] == ["closed", "closed", "not_started", "open", "x"]
    assert not one(spark, status.is_stale(at("2026-07-02 00:00:00"), now)) and one(spark, status.is_stale(at("2026-07-01 23:59:59"), now)) and one(spark, status.is_stale(at(None), now))
    assert one(spark, status.refresh_priority(F.lit("unknown"), at("2026-08-08"), now)) == "high" and one(spark, status.refresh_priority(F.lit("unknown"), at(None), now)) == "medium"
    assert one(spark, status.phase_status(F.lit("2026-01-01"), F.lit(None).cast("string"), F.lit("2026-02-01"))) == "open"
    assert [one(spark, status.outcome(F.lit(h).cast("int"), F.lit(True), F.lit(True))) for h in (403, 404, 429, 503, 200)] == ["blocked", "invalid", "deferred", "deferred", "done"]
    assert one(spark, status.percentage(F.lit(1), F.lit(0))) == 0 and one(spark, status.percentage(F.lit(1), F.lit(3))) == 33.3


def test_clock(spark):
    assert one(spark, clock.iso_date(F.lit(2026), F.lit(2), F.lit(30))) is None and one(spark, clock.iso_date(F.lit(2026), F.lit(2), F.lit(3))) == "2026-02-03"
    assert one(spark, clock.clock_time(F.lit("at 9:05."))) == "09:05" and one(spark, clock.clock_time(F.lit("24:00"))) is None
    at = lambda x: F.lit(x).cast("timestamp")
    now = at("2026-08-01 12:00:00")
    group = lambda x, z="UTC": one(spark, clock.deadline_group(at(x), now, z))
    assert [group(None), group("2026-08-01 11:59:59"), group("2026-08-01 12:00:00"), group("2026-08-08 12:00:00"), group("2026-08-09"), group("2026-08-02 01:00:00"), group("2026-08-01 16:00:00", "Asia/Tokyo")] == ["unknown", "overdue", "today", "week", "later", "week", "week"]
    asked = lambda v: one(spark, clock.retry_after_ms(F.lit(v), now))
    assert [asked(x) for x in ("5", "0.25", "-1", "", None, "soon", "Sat, 01 Aug 2026 12:00:30 GMT", "Sat, 01 Aug 2026 11:00:00 GMT")] == [5000, 250, None, None, None, None, 30_000, 0]
    wait = lambda n, ms, r: one(spark, clock.retry_delay_ms(F.lit(n), F.lit(ms).cast("long"), F.lit(r)))
    assert [wait(1, 900_000, 0.0), wait(1, 0, 0.5), wait(0, None, 0.5), wait(1, None, 0.0), wait(3, None, 1.0), wait(20, None, 0.5), wait(2, None, 7.0)] == [60_000, 0, 500, 375, 2500, 30_000, 1250]
    assert one(spark, clock.months_from(F.lit("2026-11-15").cast("date"), 3)) == ["2026-11", "2026-12", "2027-01"]
    assert one(spark, clock.countdown(at("2026-08-02 13:30:00"), now)) == "1 天 1 小时 30 分钟" and one(spark, clock.countdown(at("2026-07-01"), now)) == "0 分钟" and one(spark, clock.countdown(at("2026-08-02 12:05:59"), now)) == "1 天 5 分钟"
    assert [one(spark, clock.freshness_bucket(F.lit(x).cast("double"))) for x in (None, float("nan"), 23, 24, 168, 169)] == ["unknown", "<24h", "<24h", "1-3d", "3-7d", ">7d"]


def test_geometry(spark):
    assert one(spark, F.size(geometry.polar_ring(12, F.lit(5.0)))) == 12 and one(spark, F.size(geometry.grid(3, 4, 1.0, 2.0))) == 12
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0, 0.001), (1, 0), (1, 1), (0, 1))])
    assert one(spark, geometry.simplify_ring(square)) == [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]


def test_calendar(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, calendar.utc_stamp(F.to_timestamp(F.col("a"))), a="2026-08-12T18:00:00+09:00") == "20260812T090000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    long = "あ" * 60
    lines = one(spark, calendar.folded(F.col("a")), a=long).split("\r\n ")
    assert "".join(lines) == long and [len(x.encode()) for x in lines] == [75, 72, 33] and one(spark, calendar.folded(F.col("a")), a="x" * 75) == "x" * 75


def test_rings(spark):
    square = lambda x, s: [[x, 1.0], [x + s, 1.0], [x + s, 1.0 + s], [x, 1.0 + s]]
    small = [square(0.0, 0.02), square(8.0, 0.02), square(3.0, 0.01)]
    assert one(spark, F.transform(geometry.main_rings(F.col("a")), lambda r: r[0][0]), a=small) == [0.0]
    assert one(spark, F.size(geometry.main_rings(F.col("a"))), a=[[[1.0, 1.0], [1.001, 1.0]]]) == 0
