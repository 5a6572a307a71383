"""Pages of single sites to shows: a venue's page of one show, and two tours' lists of dates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from confluo.functions import clock, text, urls
from confluo.sources.html import has_class, parsed

# Classes of a venue's page of one show, and why such a page is not read.
DETAIL, TITLES, PRICE_CELL = "sch-single-table", ("sch-single-headelin-ttl", "sch-single-headeline02"), "sch-single-table-price"
OPEN_CELL, START_CELL = "sch-single-table-time__open", "sch-single-table-time__start"
CHANGED = "Zepp 详情页缺少 .sch-single-table 或标题节点，页面结构可能已变化"
OWN_SITE, CONTACT = "公式サイト", "問い合わせ"
# A line of the first tour's list, prefectures before its venues, and the classes of the second's.
QUOTED = re.compile(r"^([0-9]{1,2})/\s*([0-9]{1,2})\s*\([^)]+\)\s*OPEN\s*([0-9]{2}:[0-9]{2})\s*/\s*START\s*([0-9]{2}:[0-9]{2})")
PREFECTURE = r"^(?:長野|神奈川|大阪|福岡|宮城|愛知)\s+"
LISTED, LISTED_DATE, LISTED_VENUE, LISTED_TIME = "sched-list", "sched-date", "sched-venue", "sched-time"
HIDDEN = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff"))

# What holds for every show of a tour, for each of the two.
QUOTED_TOUR = {
    "year": 2026,
    "title": "米津玄師 2026 TOUR / GHOST",
    "artist_names": ["米津玄師"],
    "prices": [9900],
    "ticket_types": [("指定席", 9900, True, []), ("注釈付指定席", 9900, True, []), ("立見", 9900, True, ["長野・大阪・福岡・宮城公演"])],
    "ticket_phases": [("一般販売（抽選）", "playguide_lottery", "2026-07-07", "2026-07-26", "https://ticket.kenshiyonezu.jp/tour/2026")],
    "eligibility": [],
    "purchase_urls": ["https://ticket.kenshiyonezu.jp/tour/2026"],
}
LISTED_TOUR = {
    "title": "椎名林檎と彼奴等と試す煩悩菩提",
    "artist_names": ["椎名林檎"],
    "prices": [12500],
    "ticket_types": [],
    "ticket_phases": [
        ("林檎班 会員先行", "fc_lottery", "2026-07-15", "2026-07-27", "https://www.kronekodow.com/ringohan/"),
        ("SR猫柳本線ポケット リニア会員先行", "fc_lottery", "2026-07-27", "2026-08-05", "https://sp.kronekodow.com/"),
        ("SR猫柳本線ポケット 会員先行", "fc_lottery", "2026-08-03", "2026-08-12", "https://sp.kronekodow.com/"),
        ("一般発売（詳細は公式発表を確認）", "general", "2026-10-04", "2026-10-04", None),
    ],
    "eligibility": [("林檎班会員", "林檎班 会員先行"), ("SR猫柳本線ポケット リニア会員（会員歴3年以上）", "SR猫柳本線ポケット リニア会員先行"), ("SR猫柳本線ポケット会員", "SR猫柳本線ポケット 会員先行")],
    "purchase_urls": ["https://www.kronekodow.com/ringohan/", "https://sp.kronekodow.com/", None],
}

TYPE_FIELDS = "array<struct<name:string,price_jpy:bigint,tax_included:boolean,notes:array<string>>>"
PHASE_FIELDS = "array<struct<name:string,kind:string,start:string,end:string,url:string>>"
RULE_FIELDS = "array<struct<label:string,applies_to:string>>"
DETAIL_ROW = "ok boolean, reason string, title string, text string, price_text string, open_times array<string>, start_times array<string>, links array<struct<url:string,label:string>>"
SHOW_ROW = StructType().add("month", "string").add("day", "string").add("date", "string").add("open_time", "string").add("start_time", "string").add("venue_name", "string")


@udtf(returnType=DETAIL_ROW)
class ShowDetail:
    """One row for a venue's page of a show; without its table or title `ok` is false, and the reason says so. Links come with the
    label of the list they are in."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        page = parsed(html)
        first = lambda name: next((e for e in page.found if has_class(e, name)), None)
        detail = first(DETAIL)
        title = next((t for t in (page.text(e) for e in map(first, TITLES) if e is not None) if t), "")
        if detail is None or not title:
            yield (False, CHANGED, None, None, None, [], [], [])
            return

        def label(link: dict) -> str:
            around = next((x for x in page.around(link) if x["tag"] == "dl"), None)
            names = page.inside(around, tag="dt") if around is not None else []
            return page.text(names[0]) if names else ""

        texts = lambda name: [t for t in map(page.text, page.inside(detail, of_class=name)) if t]
        links = [(urljoin(url or "", e["attrs"]["href"]), label(e)) for e in page.inside(detail, tag="a") if e["attrs"].get("href")]
        yield (True, None, title, page.text(detail), " ".join(texts(PRICE_CELL)), texts(OPEN_CELL), texts(START_CELL), links)


@udtf(returnType=SHOW_ROW)
class QuotedShows:
    """The shows of the first tour's page: paragraphs in quotes, with the venue as the last strong text."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = parsed(html)
        plain = lambda e: " ".join(page.raw(e).translate(HIDDEN).split())
        for e in page.found:
            found = QUOTED.match(plain(e)) if e["tag"] == "p" and any(x["tag"] == "blockquote" for x in page.around(e)) else None
            if found:
                strong = page.inside(e, tag="strong")
                yield (found[1], found[2], None, found[3], found[4], re.sub(PREFECTURE, "", plain(strong[-1])) if strong else "")


@udtf(returnType=SHOW_ROW)
class ListedShows:
    """The shows of the second tour's page: items of its list, with times as opening/start."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = parsed(html)
        for e in page.found:
            if e["tag"] == "li" and any(has_class(x, LISTED) for x in page.around(e)):
                of = lambda name: " ".join("".join(page.raw(x) for x in page.inside(e, of_class=name)).translate(HIDDEN).split())  # noqa: B023, E731
                times = [*map(str.strip, of(LISTED_TIME).split("/")), None]
                yield (None, None, of(LISTED_DATE).replace(".", "-"), times[0], times[1], of(LISTED_VENUE))


def register(spark) -> None:
    """Make the table functions known to SQL: show_detail, quoted_shows, listed_shows."""
    for name, f in (("show_detail", ShowDetail), ("quoted_shows", QuotedShows), ("listed_shows", ListedShows)):
        spark.udtf.register(name, f)


def structs(rows: list, kind: str, url: Column | None = None) -> Column:
    """Fixed rows as an array of structs; an address that is left out is that of the page."""
    value = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else url if x is None else F.lit(x)
    one = kind.removeprefix("array<").removesuffix(">")
    return F.array(*[(F.struct(*map(value, r)) if isinstance(r, tuple) else value(r)).cast(one) for r in rows]).cast(kind)


def details(pages: DataFrame) -> DataFrame:
    """pages: html, url, and others, which pass. A row for each: ok, reason, title, ticket_types, prices, tax_included, fees, eligibility,
    open_times, start_times, links (role, url; each once, those whose role is told), purchase_urls."""
    spark = pages.sparkSession
    register(spark)
    rows = spark.sql("SELECT p.*, e.* FROM {pages} AS p, LATERAL show_detail(p.html, p.url) AS e", pages=pages)
    role = lambda x: F.when(urls.sells_tickets(x["url"]), "ticket_detail").when(x["label"].contains(OWN_SITE), "artist_official").when(x["label"].contains(CONTACT), "promoter_official")
    linked = F.array_distinct(F.filter(F.transform("links", lambda x: F.struct(role(x).alias("role"), x["url"].alias("url"))), lambda x: x["role"].isNotNull()))
    rows = rows.withColumns({"links": linked, "ticket_types": F.when(F.col("ok"), text.ticket_types(F.col("price_text"))), "fees": F.when(F.col("ok"), text.additional_fees(F.col("text")))})
    return rows.withColumns({
        "prices": F.array_sort(F.array_distinct(F.transform("ticket_types", lambda x: x["price_jpy"]))), "tax_included": text.tax_included(F.col("price_text")), "eligibility": F.when(F.col("ok"), text.eligibility(F.col("text"))),
        "purchase_urls": F.transform(F.filter("links", lambda x: x["role"] == "ticket_detail"), lambda x: x["url"]),
    }).drop("text", "price_text")


def tour_shows(pages: DataFrame, tour: dict, function: str) -> DataFrame:
    """The shows that `quoted_shows` or `listed_shows` finds, with what holds for all of the tour. pages: html, url, and others,
    which pass. Shows without a real date or a venue are left out (a list's date is held against its form alone)."""
    spark = pages.sparkSession
    register(spark)
    rows = spark.sql(f"SELECT p.*, e.* FROM {{pages}} AS p, LATERAL {function}(p.html) AS e", pages=pages)
    written = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))
    rows = rows.withColumn("date", F.coalesce(written, clock.iso_date(F.lit(tour["year"]), F.col("month"), F.col("day"))) if "year" in tour else written)
    kinds = {"artist_names": "array<string>", "prices": "array<bigint>", "ticket_types": TYPE_FIELDS, "ticket_phases": PHASE_FIELDS, "eligibility": RULE_FIELDS, "purchase_urls": "array<string>"}
    fixed = {name: structs(tour[name], kind, F.col("url")) for name, kind in kinds.items()}
    found = rows.filter(F.col("date").isNotNull() & (F.col("venue_name") != "")).drop("month", "day")
    return found.withColumns({"source_event_id": F.concat_ws("|", "date", "venue_name"), "title": F.lit(tour["title"]), **fixed})
