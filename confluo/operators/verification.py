"""The matrix of what is verified about an event: fourteen fields, each with value, sources, time, change and conflicts.

Offers of an event that say the same count once, as the first of them; what is left is one list an event, in the order of the
offers, from which each field takes its distinct values and sources. All is keyed by the event alone, so offers that are dealt out
by event_id already are not shuffled again, and what is compared are rows of events, not of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.urls import bound
from confluo.operators.offers import NOT_FOR_SALE, instant

# Fields in order with their labels, reasons for unknown ones, and what is said of yes and no.
FIELDS = {
    "officialEventDetail": "官方演出详情", "officialTicketPage": "官方票务具体场次页", "visibleSalePhase": "当前可见申请阶段", "eligibility": "资格条件", "membershipRequirement": "会员／账号要求", "phoneRegion": "手机号／地区限制", "ticketApp": "电子票 App", "identityCheck": "本人确认",
    "companionDistribution": "同行者／票券分配", "applicationWindow": "申请开始／截止", "resultAt": "结果公布时间", "paymentDeadline": "付款期限", "ticketDisplayAt": "票券显示／下载时间", "lastVerifiedAt": "最近核验时间",
}
UNDISCLOSED = "官方来源尚未披露"
REASONS = {"officialEventDetail": "正式 Event 尚无可追溯官方详情来源", "officialTicketPage": "尚无已确认的具体场次票务页", "lastVerifiedAt": "尚无核验时间记录"}
PHONE, IDENTITY = ("需要日本手机号", "官方说明不需要日本手机号"), ("官方说明需要本人确认", "官方说明不需要本人确认")
NO_START, NO_END, JOIN = "开始未说明", "截止未说明", "；"
#: Facts whose conflicts count for a field of another name.
CONFLICTS = {"start_at": "applicationWindow", "end_at": "applicationWindow", "requires_japanese_phone": "phoneRegion", "region_restriction": "phoneRegion", "phone_verification": "phoneRegion", "companion_restriction": "companionDistribution", "ticket_distribution": "companionDistribution"} | {
    "result_at": "resultAt", "payment_deadline": "paymentDeadline", "ticket_display_at": "ticketDisplayAt", "eligibility": "eligibility", "membership_requirement": "membershipRequirement", "ticket_app": "ticketApp", "identity_check": "identityCheck",
}
OFFER = "event_id string, seq long, url string, source_url string, url_kind string, provider_label string, sale_status string, eligibility array<string>, membership_requirement string, requires_japanese_phone boolean, region_restriction string, phone_verification string, ticket_app string, identity_check boolean, companion_restriction string, ticket_distribution string, start_at string, end_at string, result_at string, payment_deadline string, ticket_display_at string, last_verified_at string"


def known(c: Column) -> Column:
    return F.when(~F.coalesce(c, F.lit("")).isin("", "unknown"), c)


def said(c: Column, words: tuple[str, str]) -> Column:
    return F.when(c, words[0]).when(~c, words[1])


def facts() -> dict[str, Column]:
    """Of each field the list of what an offer says; nulls say nothing."""
    col, listed = F.col, lambda *cs: F.array(*cs)
    given = lambda c: F.coalesce(col(c), F.lit("")) != ""
    of_provider = lambda c: F.when(known(col(c)).isNotNull(), F.concat("provider_label", F.lit("："), col(c)))
    window = F.when(given("start_at") | given("end_at"), F.concat("provider_label", F.lit("："), F.coalesce("start_at", F.lit(NO_START)), F.lit(" → "), F.coalesce("end_at", F.lit(NO_END))))
    one = {"membershipRequirement": "membership_requirement", "ticketApp": "ticket_app"}
    timed = {"resultAt": "result_at", "paymentDeadline": "payment_deadline", "ticketDisplayAt": "ticket_display_at"}
    return {
        "officialTicketPage": listed(*[F.when(col("url_kind") == "event_detail", F.nullif(col(c), F.lit(""))) for c in ("source_url", "url")]), "visibleSalePhase": listed(of_provider("sale_status")),
        "eligibility": F.col("eligibility"), "phoneRegion": listed(said(col("requires_japanese_phone"), PHONE), known(col("region_restriction")), known(col("phone_verification"))),
        "identityCheck": listed(said(col("identity_check"), IDENTITY)), "companionDistribution": listed(known(col("companion_restriction")), known(col("ticket_distribution"))), "applicationWindow": listed(window),
        **{f: listed(known(col(c))) for f, c in one.items()}, **{f: listed(of_provider(c)) for f, c in timed.items()},
    }


def held(events: DataFrame, offers: DataFrame) -> DataFrame:
    """event_id, checked_at, own (its sources, joined), offers (what they say: seq, the facts, links, checked): a row for each event.
    events: id, checked_at, source_urls."""
    sold = offers.filter(~F.coalesce(F.col("url_kind").isin(*NOT_FOR_SALE), F.lit(False)))
    told = {f: F.coalesce(F.filter(c, lambda v: known(v).isNotNull()), F.array().cast("array<string>")) for f, c in facts().items()}
    links = F.array(*[F.nullif(F.col(c), F.lit("")) for c in ("source_url", "url")])
    checked = F.when(instant(F.col("last_verified_at")).isNotNull(), F.col("last_verified_at"))
    said_once = sold.groupBy("event_id", *[c.alias(f) for f, c in told.items()], links.alias("links"), checked.alias("checked")).agg(F.min("seq").alias("seq"))
    listed = said_once.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("seq", *told, "links", "checked"))).alias("offers"))
    own = F.array_join(F.array_distinct(F.filter(F.coalesce("source_urls", F.array().cast("array<string>")), lambda u: u != "")), JOIN)
    return events.select(F.col("id").alias("event_id"), "checked_at", own.alias("own")).join(listed, "event_id", "left")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def once(lists: Column) -> Column:
    """The distinct members of lists in the order in which they first come, joined; nulls aside."""
    return F.array_join(F.array_distinct(F.flatten(lists)), JOIN)


def values() -> dict[str, Column]:
    """Of each field its value, null if unknown, from the columns of `held`."""
    latest = F.coalesce(F.array_max(F.col("offers")["checked"]), F.col("checked_at"))
    return {f: filled(F.col("own") if f == "officialEventDetail" else latest if f == "lastVerifiedAt" else once(F.col("offers")[f])) for f in FIELDS}


def proofs() -> dict[str, Column]:
    """Of each field its sources and when it was verified: those of the offers that say something of it."""

    def of(offers: Column, sources, time) -> Column:
        return bound(offers, lambda x: F.struct(F.coalesce(sources(once(x["links"])), F.lit("")).alias("sources"), time(F.array_max(x["checked"])).alias("verified_at")))

    own, at, same = F.col("own"), F.col("checked_at"), lambda x: x
    saying = lambda f: F.filter("offers", lambda x: F.size(x[f]) > 0)
    out = {f: of(saying(f), same, same) for f in facts()}
    return out | {"officialEventDetail": F.struct(own.alias("sources"), at.alias("verified_at")), "lastVerifiedAt": of(F.col("offers"), lambda x: F.coalesce(filled(x), own), lambda x: F.coalesce(x, at))}


def matrix(events_before: DataFrame, offers_before: DataFrame, events_after: DataFrame, offers_after: DataFrame, conflicts: DataFrame) -> DataFrame:
    """event_id, field, label, current_value, source_urls, last_verified_at, changed, unknown_reason, requires_manual, n_conflicts: a row
    for each event after and each field. An event that was not there before changes wherever it has a value. conflicts: event_id,
    field (a fact, as offers.conflicts names it)."""
    value, proof = values(), proofs()
    after = held(events_after, offers_after).select("event_id", F.array(*[value[f] for f in FIELDS]).alias("_value"), F.array(*[proof[f] for f in FIELDS]).alias("_proof"))
    before = held(events_before, offers_before).select("event_id", F.array(*[value[f] for f in FIELDS]).alias("_before"))
    renamed = F.create_map(*[F.lit(x) for pair in CONFLICTS.items() for x in pair])
    counted = conflicts.select("event_id", F.coalesce(F.element_at(renamed, F.col("field")), F.col("field")).alias("field")).groupBy("event_id", "field").agg(F.count("*").alias("n"))
    found = counted.filter("field IS NOT NULL").groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "n"))).alias("_n"))
    labels, reasons = (F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) for names in (FIELDS, REASONS))
    whole = after.join(before, "event_id", "left").join(found, "event_id", "left")
    # Exploded by the names of the fields: by a list of the event, Spark would filter by it, and make it twice.
    out = whole.select("*", F.posexplode(F.array(*map(F.lit, FIELDS))).alias("_i", "field"))
    current, n = F.get("_value", F.col("_i")), F.try_element_at("_n", F.col("field"))
    return out.select(
        "event_id", "field", labels[F.col("field")].alias("label"), current.alias("current_value"), F.get("_proof", F.col("_i"))["sources"].alias("source_urls"), F.get("_proof", F.col("_i"))["verified_at"].alias("last_verified_at"), (~current.eqNullSafe(F.get("_before", F.col("_i")))).alias("changed"),
        F.when(current.isNull(), F.coalesce(F.try_element_at(reasons, F.col("field")), F.lit(UNDISCLOSED))).alias("unknown_reason"), n.isNotNull().alias("requires_manual"), F.coalesce(n, F.lit(0)).alias("n_conflicts"),
    )
