"""Queries over what venues' and tours' pages say of shows, and over texts of prices. The tables hold no such pages, so both sides
put them before each page, by its id; the SQL states what they say, without reading them."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import text
from confluo.plans.catalogue import query, table
from confluo.sources import shows

PRICED = """CASE p_partkey % 12 WHEN 0 THEN '[S席] ¥' || p_size || ',000 [A席] ￥1,000 （税込）' WHEN 1 THEN 'PRICE 前売 / ¥' || p_size || ' 当日：￥2,500 税別' WHEN 2 THEN '[S] ¥500 S / ¥500 立見 / ¥700' WHEN 3 THEN '¥3,000 ¥4,000' WHEN 4 THEN '全席：¥1,234 別途ドリンク代 600円必要'
WHEN 5 THEN 'drink fee ¥ 500 tax included 前方 ／ ¥9,000' WHEN 6 THEN 'ドリンク別' WHEN 7 THEN '無料' WHEN 8 THEN 'チケット 一般 / ¥,,' WHEN 9 THEN NULL WHEN 10 THEN 'tax excluded 立見 / ¥2,000 立見 / ¥2,000' ELSE p_name || ' : ¥' || p_partkey END"""
_NUMBER = "CASE WHEN replace({0}, ',', '') = '' THEN 0 ELSE TRY_CAST(replace({0}, ',', '') AS BIGINT) END"
_BRACKET, _SLASH = r"\[([^\]\n]+)\]\s*[¥￥]\s*([\d,]+)", r"(?:^|[\]\s])([^¥￥\n]+?)\s*[/／:：]\s*[¥￥]\s*([\d,]+)"
_NAME = r"trim(regexp_replace(regexp_replace(regexp_replace(x[1], '(?i)^.*(?:\[PRICE\]|PRICE)\s*', ''), '(?i)^(?:PRICE|料金|チケット)\s*', ''), '^[\[\]\s]+|[\[\]\s]+$', '', 'g'))"


def _zipped(pattern: str, name: str) -> str:
    pairs = f"list_zip(regexp_extract_all(t, '{pattern}', 1), regexp_extract_all(t, '{pattern}', 2))"
    return f"list_transform(list_filter({pairs}, lambda x: {name} <> ''), lambda x: {name} || '=' || {_NUMBER.format('x[2]')})"


@query(rf"""WITH p AS (SELECT p_partkey, coalesce({PRICED}, '') AS t FROM part), f AS (SELECT *, {_zipped(_BRACKET, "trim(x[1])")} AS b, {_zipped(_SLASH, _NAME)} AS s, regexp_extract(t, '[¥￥]\s*([\d,]+)', 1) AS one, regexp_extract(t, '(?i)(?:別途\s*)?(?:ドリンク|drink)(?:代|料金|fee)?[^¥￥\d]{{0,12}}[¥￥]?\s*([\d,]+)', 1) AS fee FROM p),
n AS (SELECT *, list_concat(b, list_distinct(list_filter(s, lambda x: NOT list_contains(b, x)))) AS named FROM f)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN len(named) > 0 THEN named WHEN one <> '' THEN ['=' || {_NUMBER.format("one")}] ELSE [] END), ';') AS types, CASE WHEN regexp_matches(t, '(?i)税込|tax\s*included') THEN TRUE WHEN regexp_matches(t, '(?i)税別|税抜|tax\s*excluded') THEN FALSE END AS tax_included,
CASE WHEN fee <> '' THEN {_NUMBER.format("fee")} END AS drink_fee, fee <> '' OR regexp_matches(t, '(?i)(?:ドリンク|drink)(?:代|料金|fee)?[^。、]{{0,12}}(?:必要|別)') AS drink FROM n""")
def ticket_texts(spark, d):
    """Types of tickets, tax and fees of texts of prices."""
    t = F.expr(PRICED)
    types = F.transform(text.ticket_types(t), lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit("="), x["price_jpy"].cast("string")))
    fees = text.additional_fees(t)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(types), ";").alias("types"), text.tax_included(t).alias("tax_included"), F.get(fees, F.lit(0))["amount_jpy"].alias("drink_fee"), (F.size(fees) > 0).alias("drink"))


_CELLS = """'<table class="a sch-single-table"><tr><td class="sch-single-table-price">[S席] ¥' || page_id || ' 税込</td></tr><tr><td class="sch-single-table-time__open"> 17:00 </td><td class="sch-single-table-time__start">18:30</td></tr><tr><td>小学生以上有料 別途ドリンク代 ¥600
<dl><dt>公式サイト</dt><dd><a href="/band">b</a><a href="/band">again</a></dd></dl><dl><dt>お問い合わせ</dt><dd><a href="https://ask.example/">c</a></dd></dl><a href="https://eplus.jp/sf/detail/' || page_id || '">d</a><a href="https://eplus.jp/">home</a></td></tr></table><a href="https://eplus.jp/sf/detail/out">e</a>'"""
SHOW_PAGE = f"""CASE page_id % 5 WHEN 0 THEN '<h1 class="sch-single-headelin-ttl">Live  ' || page_id || '</h1>' || {_CELLS} WHEN 1 THEN '<h1 class="sch-single-headelin-ttl"> </h1><h2 class="sch-single-headeline02 b">Show ' || page_id || '</h2>' || {_CELLS} WHEN 2 THEN '<h1>Live</h1>' || {_CELLS} WHEN 3 THEN '<h1 class="sch-single-headelin-ttl">Live</h1>' ELSE '' END"""


@query("""SELECT page_id, page_id % 5 < 2 AS ok, CASE WHEN page_id % 5 >= 2 THEN 'Zepp 详情页缺少 .sch-single-table 或标题节点，页面结构可能已变化' END AS reason, CASE page_id % 5 WHEN 0 THEN 'Live ' || page_id WHEN 1 THEN 'Show ' || page_id END AS title, CASE WHEN page_id % 5 < 2 THEN 'S席=' || page_id ELSE '' END AS types, CASE WHEN page_id % 5 < 2 THEN TRUE END AS tax_included,
CAST(CASE WHEN page_id % 5 < 2 THEN 600 END AS BIGINT) AS drink_fee, CASE WHEN page_id % 5 < 2 THEN '小学生以上有料' ELSE '' END AS rules, CASE WHEN page_id % 5 < 2 THEN '17:00-18:30' ELSE '-' END AS times,
CASE WHEN page_id % 5 < 2 THEN 'artist_official https://venue.example/band, promoter_official https://ask.example/, ticket_detail https://eplus.jp/sf/detail/' || page_id ELSE '' END AS links, CASE WHEN page_id % 5 < 2 THEN 'https://eplus.jp/sf/detail/' || page_id ELSE '' END AS purchase FROM pages""")
def show_details(spark, d):
    """What a venue's page of one show says; pages of another shape are told apart."""
    pages = table(spark, d, "pages").select("page_id", F.concat(F.expr(SHOW_PAGE), F.coalesce("html", F.lit(""))).alias("html"), F.lit("https://venue.example/show/1").alias("url"))
    joined = lambda c, f, by: F.coalesce(F.array_join(F.transform(c, f), by), F.lit(""))
    return shows.details(pages).select(
        "page_id", "ok", "reason", "title", joined("ticket_types", lambda x: F.concat_ws("=", x["name"], x["price_jpy"].cast("string")), ";").alias("types"), "tax_included", F.get("fees", F.lit(0))["amount_jpy"].alias("drink_fee"),
        joined("eligibility", lambda x: x["label"], ",").alias("rules"), F.concat_ws("-", F.array_join("open_times", ","), F.array_join("start_times", ",")).alias("times"), joined("links", lambda x: F.concat_ws(" ", x["role"], x["url"]), ", ").alias("links"), joined("purchase_urls", lambda x: x, ", ").alias("purchase"),
    )


QUOTED_PAGE = """'<blockquote><p>' || (page_id % 13 + 1) || '/ ' || (page_id % 31 + 1) || ' (土)  OPEN 17:00 / START 18:30<br><strong>date</strong><strong>大阪 Hall ' || page_id || '</strong></p><p>7/1 (金) START 18:00<strong>no opening</strong></p><p>7/2 (土) OPEN 17:00/START 18:00</p></blockquote><p>7/1 (金) OPEN 17:00 / START 18:00<strong>not quoted</strong></p>'"""
LISTED_PAGE = """'<ul class="x sched-list"><li><span class="sched-date">2026.10.' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0') || '</span><b class="sched-venue"> Dome  ' || page_id || '</b><i class="sched-time">17:30 / 18:30</i></li><li><span class="sched-date">2026.11.01</span><b class="sched-venue">Arena</b></li><li><span class="sched-date">TBA</span><b class="sched-venue">x</b></li><li><span class="sched-date">2026.12.01</span></li></ul>'"""


@query("""WITH q AS (SELECT page_id, url, page_id % 13 + 1 AS m, page_id % 31 + 1 AS d FROM pages), a AS (SELECT page_id, 'quoted' AS tour, '2026-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS date, 'Hall ' || page_id AS venue_name, '17:00' AS open_time, '18:30' AS start_time, 'https://ticket.kenshiyonezu.jp/tour/2026' AS last_url, 3 AS n_types, 1 AS n_phases, 9900 AS price FROM q),
b AS (SELECT page_id, 'listed' AS tour, '2026-10-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date, 'Dome ' || page_id AS venue_name, '17:30' AS open_time, '18:30' AS start_time, url AS last_url, 0 AS n_types, 4 AS n_phases, 12500 AS price FROM pages),
c AS (SELECT page_id, 'listed' AS tour, '2026-11-01' AS date, 'Arena' AS venue_name, '' AS open_time, NULL AS start_time, url AS last_url, 0 AS n_types, 4 AS n_phases, 12500 AS price FROM pages)
SELECT *, date || '|' || venue_name AS source_event_id FROM (SELECT * FROM a WHERE TRY_CAST(date AS DATE) IS NOT NULL UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def tour_dates(spark, d):
    """The shows of two tours' pages, with what holds for all of a tour."""

    def found(made: str, tour: dict, function: str, name: str):
        pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.expr(made), F.coalesce("html", F.lit(""))).alias("html"))
        rows = shows.tour_shows(pages, tour, function)
        return rows.select("page_id", F.lit(name).alias("tour"), "date", "venue_name", "open_time", "start_time", F.element_at("purchase_urls", -1).alias("last_url"), F.size("ticket_types").alias("n_types"), F.size("ticket_phases").alias("n_phases"), F.get("prices", F.lit(0)).cast("int").alias("price"), "source_event_id")

    return found(QUOTED_PAGE, shows.QUOTED_TOUR, "quoted_shows", "quoted").unionByName(found(LISTED_PAGE, shows.LISTED_TOUR, "listed_shows", "listed"))
