"""Enrichment of listed shows by their detail pages, field by field.

A list names each show's page; the page is read once, however many shows name it. What the page says then meets the listed
row by rules declared for each field, so that another venue is another table of rules and not other code. A page that could
not be fetched or read leaves the row's facts, marks the fields it would have told, and is kept in the row's chain of sources.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.operators.ranking import keep_last

# States of a field and of a fetch.
PUBLISHED, NOT_FOUND, FETCH_FAILED, PARSER_FAILED, SUCCESS, NOT_CHECKED = "published", "not_found_on_page", "page_fetch_failed", "parser_failed", "success", "not_checked"

LINK = "struct<role: string, source_id: string, url: string, fetch_status: string, content_hash: string, content_type: string, http_status: int, fetched_at: string>"
#: What enrich() needs of a listed row, besides others, which pass.
LISTED = {"source_url": "string", "open_time": "string", "start_time": "string", "ticket_url": "string", "source_chain": f"array<{LINK}>", "field_availability": "map<string, string>", "parser_errors": "array<string>"}
#: And of a detail page; `availability` is null where a page was fetched.
DETAIL = {"url": "string", "ok": "boolean", "reason": "string", "availability": "string", "links": "array<struct<role: string, url: string>>", "open_times": "array<string>", "start_times": "array<string>", "content_hash": "string", "content_type": "string", "http_status": "int", "fetched_at": "string"}


@dataclass(frozen=True)
class Merge:
    """How a field of lists meets the page's.

    value: `filled` takes the page's list where it has members, `success` wherever the page was read, `union` adds the
    page's members to the row's, whatever the page's state.
    found: the state of the field where the page was read and its list is empty: `not_found_on_page`, or None to keep it.
    failed: whether a failed page marks the field.
    """

    value: str
    found: str | None = NOT_FOUND
    failed: bool = True


@dataclass(frozen=True)
class Rules:
    source_id: str
    prefix: str  #: of errors
    fields: Mapping[str, Merge]
    names: Mapping[str, str] = field(default_factory=dict)  #: of fields in `field_availability`, where they differ
    times: bool = False  #: whether open and start times that are missing may come from the page
    ticket_url: bool = False  #: whether the first purchase link becomes the ticket link
    links_of_failed: bool = False  #: whether links of a page that could not be read join the chain
    without_page: tuple[str, ...] = ("ticketPhases",)  #: fields that no page tells: marked not found where it was read


_NAMES = {"ticket_types": "ticketTypes", "prices_jpy": "prices", "additional_fees": "additionalFees", "eligibility": "eligibility", "purchase_urls": "purchaseUrls"}


def hall(source_id: str, prefix: str = "zepp-detail") -> Rules:
    """Rules of a hall's page: it replaces fees, eligibility and links, and may tell a single show's times."""
    own = {"ticket_types": Merge("filled", None, False), "prices_jpy": Merge("filled", None, False), "additional_fees": Merge("success"), "eligibility": Merge("success"), "purchase_urls": Merge("success")}
    return Rules(source_id, prefix, own, _NAMES, times=True, ticket_url=True)


def arena(source_id: str, prefix: str = "yokohama-detail") -> Rules:
    """Rules of an arena's page: links add up, and whatever it does not tell is marked by its state."""
    own = {"ticket_types": Merge("filled"), "prices_jpy": Merge("filled"), "additional_fees": Merge("success"), "eligibility": Merge("success"), "purchase_urls": Merge("union")}
    return Rules(source_id, prefix, own, _NAMES, links_of_failed=True)


def detail_urls(listed: DataFrame, pattern: str | None = None) -> DataFrame:
    """The pages to read, each once: source_url of rows, of those that match `pattern` if one is given."""
    urls = listed.select(F.col("source_url").alias("url")).filter("url is not null").distinct()
    return urls.filter(F.col("url").rlike(pattern)) if pattern else urls


def parser_results(details: DataFrame, parser_id: str) -> DataFrame:
    """A row for each page: url, parser_id, status (success, parser_failed, or not_run where it was not fetched), error, output_count."""
    status = F.when(F.col("ok"), SUCCESS).when(F.col("availability") == FETCH_FAILED, "not_run").otherwise(PARSER_FAILED)
    return details.select("url", F.lit(parser_id).alias("parser_id"), status.alias("status"), F.when(~F.col("ok"), F.col("reason")).alias("error"), F.col("ok").cast("long").alias("output_count"))


def digest(names: list[str], without: tuple[str, ...] = ("content_hash", "fetched_at")) -> Column:
    """The hash of a row's columns by name, without those that change with each fetch."""
    own = sorted(c for c in names if c not in without)
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def enrich(listed: DataFrame, details: DataFrame, rules: Rules) -> DataFrame:
    """The listed rows with what their pages say, and with their content hash made anew where there is a page.

    listed: the columns of LISTED and a list for each field of `rules`; details: those of DETAIL and the same lists; of
    several rows of one url the last by `seq` counts, where there is one. Rows without a page pass as they are. Null lists
    count as empty.
    """
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = dict(details.dtypes)
    pages = keep_last(details, ["url"], "seq") if "seq" in details.columns else details
    pages = pages.filter("url is not null").select(F.struct(*[c for c in pages.columns if c != "seq"]).alias("_page"))
    rows = listed.join(pages, F.col("source_url") == F.col("_page.url"), "left")
    page, of = F.col("_page.url").isNotNull(), (lambda c: F.col(f"_page.{c}"))
    ok = F.coalesce(of("ok"), F.lit(False))
    state = F.when(ok, NOT_FOUND).otherwise(F.coalesce(of("availability"), F.lit(PARSER_FAILED)))

    out, marks = {}, []
    for name, rule in rules.fields.items():
        theirs, mine = empty(of(name), kinds[name]), empty(F.col(name), kinds[name])
        has = F.size(theirs) > 0
        if rule.value == "union":
            out[name] = F.when(page, F.array_distinct(F.concat(mine, theirs))).otherwise(F.col(name))
            told = has | (F.size(mine) > 0)
        else:
            out[name] = F.when(ok & (has if rule.value == "filled" else F.lit(True)), theirs).otherwise(F.col(name))
            told = ok & has
        silent = state if rule.failed else F.when(ok, F.lit(NOT_FOUND))
        if rule.found is None:
            silent = F.when(~ok, silent)
        marks.append(F.struct(F.lit(rules.names.get(name, name)).alias("key"), F.when(told, PUBLISHED).otherwise(silent).alias("value")))
    marks += [F.struct(F.lit(name).alias("key"), state.alias("value")) for name in rules.without_page]
    new = F.map_from_entries(F.filter(F.array(*marks), lambda x: x["value"].isNotNull()))
    kept = F.map_filter(F.coalesce(F.col("field_availability"), F.create_map().cast("map<string, string>")), lambda k, _: ~F.map_contains_key(new, k))
    out["field_availability"] = F.when(page, F.map_concat(kept, new)).otherwise(F.col("field_availability"))

    step = lambda role, url, status, fetched: F.struct(role.alias("role"), F.lit(rules.source_id).alias("source_id"), url.alias("url"), status.alias("fetch_status"), *[(of(c) if fetched else F.lit(None)).cast(t).alias(c) for c, t in (("content_hash", "string"), ("content_type", "string"), ("http_status", "int"), ("fetched_at", "string"))])
    own = step(F.lit("venue_detail"), F.col("source_url"), F.when(ok, SUCCESS).otherwise(state), True)
    linked = of("links") if rules.links_of_failed else F.when(ok, of("links"))
    found = F.transform(empty(linked, DETAIL["links"]), lambda x: step(x["role"], x["url"], F.lit(NOT_CHECKED), False))
    chain = empty(F.col("source_chain"), LISTED["source_chain"])
    out["source_chain"] = F.when(page, F.concat(chain, F.array(own).cast(LISTED["source_chain"]), found.cast(LISTED["source_chain"]))).otherwise(F.col("source_chain"))
    errors = F.concat(empty(F.col("parser_errors"), "array<string>"), F.array(F.concat(F.lit(f"{rules.prefix}: "), F.coalesce(of("reason"), F.lit("")))))
    out["parser_errors"] = F.when(page & ~ok, errors).otherwise(F.col("parser_errors"))
    if rules.ticket_url:
        out["ticket_url"] = F.when(ok, F.get(empty(of("purchase_urls"), "array<string>"), F.lit(0))).otherwise(F.col("ticket_url"))
    if rules.times:
        starts, opens = empty(of("start_times"), "array<string>"), empty(of("open_times"), "array<string>")
        at = F.array_position(starts, F.coalesce(F.col("start_time"), F.lit(""))).cast("int")  # 0: not there
        one = F.size(starts) == 1
        opening = F.when(one | (at > 0), F.get(opens, F.greatest(at - 1, F.lit(0))))
        out["open_time"] = F.when(ok & (F.coalesce(F.col("open_time"), F.lit("")) == ""), opening).otherwise(F.col("open_time"))
        out["start_time"] = F.when(ok & (F.coalesce(F.col("start_time"), F.lit("")) == ""), F.when(one, F.get(starts, F.lit(0)))).otherwise(F.col("start_time"))
    fresh = rows.withColumns(out).withColumn("_had", page).drop("_page")
    old = F.col("content_hash") if "content_hash" in listed.columns else F.lit(None).cast("string")
    return fresh.withColumn("content_hash", F.when(F.col("_had"), digest(listed.columns)).otherwise(old)).drop("_had")
