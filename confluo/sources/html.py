"""Pages to rows: Python UDTFs around the standard parser, for what expressions cannot walk."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Elements(HTMLParser):
    """Elements in order of their start: tag, attributes, the place of the element around, and which pieces of the page's text lie
    inside. A piece is kept once, however deep it lies; the text of an element is put together when it is asked for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.pieces: list[str] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.found.append({"tag": tag, "attrs": dict(attrs), "up": self.open[-1] if self.open else None, "from": len(self.pieces), "to": len(self.pieces) if tag in VOID else None})
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.open))):
            if self.found[self.open[i]]["tag"] == tag:
                for k in self.open[i:]:
                    self.found[k]["to"] = len(self.pieces)
                del self.open[i:]
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def raw(self, e: dict) -> str:
        return "".join(self.pieces[e["from"] : e["to"]])

    def text(self, e: dict) -> str:
        return " ".join(self.raw(e).split())

    def around(self, e: dict) -> Iterator[dict]:
        """The elements around one, the nearest first."""
        while e["up"] is not None:
            e = self.found[e["up"]]
            yield e

    def inside(self, outer: dict, *, tag: str | None = None, of_class: str | None = None) -> list[dict]:
        """The elements inside one, with this tag and class, in order."""
        return [e for e in self.found if (tag is None or e["tag"] == tag) and (of_class is None or has_class(e, of_class)) and any(x is outer for x in self.around(e))]


def has_class(e: dict, name: str) -> bool:
    return name in (e["attrs"].get("class") or "").split()


def parsed(html: str | None) -> Elements:
    p = Elements()
    p.feed(html or "")
    p.close()
    return p


@udtf(returnType=StructType().add("pos", "integer").add("tag", "string").add("class", "string").add("href", "string").add("label", "string"))
class HtmlElements:
    """The elements of a page with one of the given tags (comma-separated): place, tag, class, href, text."""

    def eval(self, html: str, tags: str) -> Iterator[tuple]:
        wanted, page = set(tags.split(",")), parsed(html)
        for i, e in enumerate(page.found):
            if e["tag"] in wanted:
                yield i, e["tag"], e["attrs"].get("class"), e["attrs"].get("href"), page.text(e)


@udtf(returnType=StructType().add("label", "string").add("value", "string"))
class HtmlTable:
    """The rows of tables and definition lists of a page, as label and value."""

    def eval(self, html: str) -> Iterator[tuple]:
        label, page = None, parsed(html)
        for e in page.found:
            if e["tag"] in ("th", "dt"):
                label = page.text(e)
            elif e["tag"] in ("td", "dd") and label:
                yield label, page.text(e)
                label = None


EVENT = "title string, date string, start_time string, venue_name string, artist_names array<string>, prices array<double>, purchase_urls array<string>, error string"
CLOCK = re.compile(r"T(\d{2}:\d{2})")


def listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def first_of(node: dict, *names: str):
    """The first of these fields that is there and not null."""
    return next((node[n] for n in names if node.get(n) is not None), None)


def named(value):
    """The name of a thing that is written as text or as an object."""
    return value.get("name") if isinstance(value, dict) else value if isinstance(value, str) else None


def number(value) -> float | None:
    try:
        x = float(value) if not isinstance(value, bool) and str(value).strip() else None
    except (TypeError, ValueError):
        return None
    return x if x is not None and math.isfinite(x) else None


def event_row(title, date: str | None, clock: str | None, venue, artists, prices, links) -> tuple:
    found = CLOCK.search(date or "")
    text = lambda x: x if isinstance(x, str) else None
    return (
        text(title), date[:10] if date else None, found.group(1) if found else text(clock), text(venue), [x for x in map(named, listed(artists)) if x],
        [x for x in map(number, prices) if x is not None], [x for x in links if isinstance(x, str)], None,
    )


def scripts(html: str, wanted) -> Iterator[tuple]:
    """(content, None) of each script for whose attributes `wanted` holds, or (None, error) where it is no JSON."""
    page = parsed(html)
    for e in page.found:
        body = page.raw(e).strip() if e["tag"] == "script" and wanted(e["attrs"]) else ""
        if body:
            try:
                yield json.loads(body), None
            except ValueError as x:
                yield None, str(x)


@udtf(returnType=EVENT)
class JsonLdEvents:
    """The events of a page's linked data: Event and MusicEvent nodes at the top or in a graph, with performers, and with
    prices and links of their offers; a block that is no JSON is a row with an error."""

    def eval(self, html: str) -> Iterator[tuple]:
        for body, error in scripts(html, lambda a: a.get("type") == "application/ld+json"):
            if error:
                yield (*[None] * 7, error)
            for top in listed(body):
                for v in [top, *listed(top.get("@graph"))] if isinstance(top, dict) else []:
                    if isinstance(v, dict) and {"Event", "MusicEvent"} & {x for x in listed(v.get("@type")) if isinstance(x, str)}:
                        offers, start = [o for o in listed(v.get("offers")) if isinstance(o, dict)], v.get("startDate")
                        yield event_row(v.get("name"), start if isinstance(start, str) else None, None, named(v.get("location")) if isinstance(v.get("location"), dict) else None, v.get("performer"), [o.get("price") for o in offers], [o.get("url") for o in offers])


@udtf(returnType=EVENT)
class EmbeddedEvents:
    """Objects with a title and date, and a venue or an artist, anywhere in a page's application data; of those with equal
    title, date and venue the first. A block that is no JSON is a row with an error."""

    def eval(self, html: str) -> Iterator[tuple]:
        seen = set()
        for body, error in scripts(html, lambda a: a.get("id") in ("__NEXT_DATA__", "__NUXT_DATA__") or a.get("type") == "application/json"):
            if error:
                yield (*[None] * 7, error)
            todo = [body]  # a stack, the next node last
            while todo:
                node = todo.pop()
                if isinstance(node, list):
                    todo += reversed(node)
                    continue
                if not isinstance(node, dict):
                    continue
                title, date = first_of(node, "title", "name"), first_of(node, "eventDate", "startDate", "date")
                inner = [x.get("name") for x in (node.get("venue"), node.get("location")) if isinstance(x, dict)]
                venue, artists = next((x for x in (node.get("venueName"), *inner) if x is not None), None), first_of(node, "artist", "performer")
                if isinstance(title, str) and isinstance(date, str) and (isinstance(venue, str) or node.get("artist") or node.get("performer")):
                    row = event_row(title, date, node.get("startTime"), venue, artists, listed(first_of(node, "prices", "price")), listed(first_of(node, "purchaseUrls", "ticketUrl", "url")))
                    if (row[0], row[1], row[3]) not in seen:
                        seen.add((row[0], row[1], row[3]))
                        yield row
                todo += reversed(node.values())


def register(spark) -> None:
    """Make the table functions known to SQL: html_elements, html_table, json_ld_events, embedded_events."""
    for name, f in (("html_elements", HtmlElements), ("html_table", HtmlTable), ("json_ld_events", JsonLdEvents), ("embedded_events", EmbeddedEvents)):
        spark.udtf.register(name, f)
