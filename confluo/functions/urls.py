"""URLs: canonical form, providers, kinds and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING = ("fbclid", "gclid", "igshid", "ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: In links shared by people, parameters that track visitors (besides all that begin with utm_) or carry credentials.
SOCIAL_TRACKING, CREDENTIALS = ("fbclid", "gclid", "igshid", "si", "ref", "source"), ("access_token", "auth_token", "session", "sessionid", "password")
#: Hosts of platforms on which people share links.
PLATFORMS = (("xhs", r"^xhslink\.com$|xiaohongshu\.com$"), ("x", r"^x\.com$|twitter\.com$"), ("instagram", r"instagram\.com$"))
#: Hosts whose pages sell tickets, and paths on them that do not.
TICKET_HOSTS = ("eplus.jp", "ticket.pia.jp", "t.pia.jp", "l-tike.com", "ticket.tickebo.jp", "ticketbook.jp", "ticket.rakuten.co.jp", "ticketpay.jp", "livepocket.jp", "zaiko.io", "cnplayguide.com")
NO_TICKETS = r"(?i)^/(?:contact|help|guide|faq|login)(?:/|$)"
#: Hosts of ticket providers.
PROVIDERS = (("eplus", r"(?:^|\.)eplus\.jp$"), ("pia", r"(?:^|\.)pia\.jp$"), ("lawson", r"(?:^|\.)l-tike\.com$"), ("ticketbook", r"(?:^|\.)ticketbook\.jp$"))
#: What tells kinds of pages by their path and query.
REFUND = r"(?:^|[/_-])refund\d*(?:[/_.-]|$)|haraimodoshi|払い?戻し?"
SUPPORT = r"(?:^|[/_-])(?:help|faq|support|guide|contact)(?:[/_.-]|$)|/hc/"
SEARCH = r"/search(?:[_/-]|/)|[?&](?:kw|keyword|q)=|search_all\.do"
OTHER_DETAIL = r"livepocket\.jp/(?:e|ticket)|tiget\.net/events|t-dv\.com/"


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, path and query of an http(s) URL; empty strings where absent."""
    whole = r"^(?i:(https?))://([^/?#]+)([^?#]*)(?:\?([^#]*))?"
    return {k: F.regexp_extract(url, whole, i) for i, k in enumerate(("scheme", "host", "path", "query"), 1)}


def bound(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def canonical(url: Column, dropped: tuple[str, ...] = TRACKING, dropped_start: str = "") -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, the others in order, no slashes at the path's end. Null for others than http(s)."""
    name = lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1)))
    gone = lambda x: name(x).isin(*dropped) | (F.startswith(name(x), F.lit(dropped_start)) if dropped_start else F.lit(False))

    def joined(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~gone(x))
        ordered = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), x.alias("x")))), lambda s: s["x"])
        path = bound(F.regexp_replace(p["path"], "/+$", ""), lambda x: F.when(x == "", "/").otherwise(x))
        query = F.when(p["query"] == "", "").otherwise(bound(F.array_join(ordered, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
        return F.when(p["host"] != "", F.concat(F.lower(p["scheme"]), F.lit("://"), F.lower(p["host"]), path, query))

    return bound(F.struct(*[c.alias(k) for k, c in parts(url).items()]), joined)


def canonical_social(url: Column) -> Column:
    """As canonical, without parameters that track or carry credentials; null where the URL names a user."""
    url = F.trim(url)
    return F.when(~parts(url)["host"].contains("@"), canonical(url, SOCIAL_TRACKING + CREDENTIALS, "utm_"))


def social_platform(url: Column) -> Column:
    """The platform of a shared link by its host, or other."""
    own, out = F.regexp_replace(host(url), r"^www\.", ""), F.lit("other")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(own.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def sells_tickets(url: Column) -> Column:
    """Whether a URL is a page of its own on a host (or a host below one) that sells tickets."""
    own, path = host(url), F.regexp_replace(parts(url)["path"], "/+$", "")
    known = F.lit(False)
    for x in TICKET_HOSTS:
        known = known | (own == x) | own.endswith(f".{x}")
    return F.coalesce(known & (path != "") & ~path.rlike(NO_TICKETS), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(parts(url)["host"])


def provider(url: Column) -> Column:
    def of(own: Column) -> Column:
        out = F.lit("other")
        for name, pattern in reversed(PROVIDERS):
            out = F.when(own.rlike(pattern), name).otherwise(out)
        return out

    return bound(host(url), of)


def kind(url: Column) -> Column:
    """refund, support, search, event_detail, generic_provider or unknown; the first that holds."""
    return bound(canonical(url), kind_of)


def kind_of(c: Column) -> Column:
    """The kind of a canonical URL."""

    def of(p: Column) -> Column:
        who, place, query = p["who"], p["place"], F.concat(F.lit("?"), p["query"])
        detail = (
            ((who == "eplus") & p["path"].contains("/sf/detail/"))
            | ((who == "pia") & p["path"].contains("/event/event.do") & query.rlike("(?i)[?&](?:eventCd|eventBundleCd)="))
            | ((who == "lawson") & p["path"].rlike("/mevent(?:/|$)") & query.rlike("(?i)[?&]mid="))
            | ((who == "ticketbook") & p["path"].rlike("/(?:event|detail|ticket)/"))
            | F.concat(p["host"], p["path"]).rlike(OTHER_DETAIL)
        )
        return (
            F.when(p["c"].isNull(), "unknown").when(place.rlike(REFUND), "refund").when(place.rlike(SUPPORT), "support")
            .when(place.rlike(SEARCH), "search").when(detail, "event_detail").when(who != "other", "generic_provider").otherwise("unknown")
        )

    def placed(p: Column) -> Column:
        place = F.lower(F.concat(p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))
        return bound(F.struct(p["c"].alias("c"), p["host"].alias("host"), p["path"].alias("path"), p["query"].alias("query"), place.alias("place"), provider(p["c"]).alias("who")), of)

    return bound(F.struct(c.alias("c"), *[x.alias(k) for k, x in parts(c).items() if k != "scheme"]), placed)


def provider_event_id(url: Column) -> Column:
    p = parts(canonical(url))
    query, who = F.concat(F.lit("?"), p["query"]), provider(url)
    get = lambda k: F.nullif(F.regexp_extract(query, f"[?&]{k}=([^&]*)", 1), F.lit(""))
    return F.when(who == "eplus", F.nullif(F.regexp_extract(p["path"], "/sf/detail/([^/?]+)", 1), F.lit(""))).when(who == "pia", F.coalesce(get("eventCd"), get("eventBundleCd"))).when(who == "lawson", get("mid")).when(who == "ticketbook", F.coalesce(get("info"), F.nullif(F.regexp_extract(p["path"], "([^/]+)$", 1), F.lit(""))))


def offer_id(event_id: Column, url: Column) -> Column:
    own = provider_event_id(url)
    return F.when(own.isNotNull(), F.concat_ws(":", F.lit("offer"), provider(url), own)).otherwise(F.concat_ws(":", F.lit("offer"), event_id, provider(url), F.url_encode(F.coalesce(canonical(url), url))))


#: Labels of links on official pages.
PROMOTER_LABEL, ARTIST_LABEL = r"主催|問い合わせ|連絡先", r"(?iu)web\s*サイト|公式|artist"


def link_role(url: Column, label: Column) -> Column:
    """What a link on an official page leads to, by its address, else by its label; null if neither tells."""
    label = F.coalesce(label, F.lit(""))
    return F.when(sells_tickets(url), "ticket_detail").when(label.rlike(PROMOTER_LABEL), "promoter_official").when(label.rlike(ARTIST_LABEL), "artist_official")


def maps_route(place: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), F.url_encode(place))
