"""Edge cases of what is checked before use."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from confluo.functions import checks
from confluo.operators import review, trips

TRIP = """id string, name string, start string, end string, event_ids array<string>, buffer int, budget array<struct<id string, kind string, label string, amount int>>,
checklist array<struct<id string, label string, done boolean, source string>>, custom array<struct<id string, date string, time string, label string, kind string>>,
legs array<struct<id string, type string, from string, to string, depart string, arrive string, status string, minutes int, reference string>>, extra int"""


def one(spark, **values):
    return spark.range(1).select(*[c.alias(n) for n, c in values.items()]).first().asDict()


def test_trips(spark):
    leg = lambda i, **x: Row(**({"id": i, "type": "bus", "from": "a", "to": "b", "depart": None, "arrive": None, "status": "confirmed", "minutes": 5, "reference": None} | x))
    full = (
        " t ", "n", "2024-03-02", "2024-03-01", ["e", "", None, "e", "f"], 900, [("b", "hotel", "x", 0), ("b", "hotel", "x", -1), ("b", "fuel", "x", 1), ("", "food", "x", 1), ("c", "merch", " ", 1)],
        [("k", "l", False, "odd"), ("k", "l", None, "manual"), (None, "l", True, None)], [("c", "2024-02-30", None, "x", "todo"), ("c", "2024-02-29", None, "x", "todo"), ("c", "2024-02-29", "25:00", "x", "todo")],
        [leg("1"), leg("2", depart="soon"), leg("3", reference="ftp://x"), leg("4", minutes=-1), leg("5", to=" "), leg("6", arrive="2024-03-01T10:00", reference="HTTP://x")], 7,
    )
    bare = ("u", "n", "2024-03-02", "2024-03-09", [], None, None, None, None, None, None)
    bad = [(None, *bare[1:]), ("v", " ", *bare[2:]), ("w", "n", "2024-13-02", *bare[3:]), ("x", "n", "2024-03-02", "2024-03-09", None, *bare[5:])]
    found = {r["id"]: r for r in trips.normalised(spark.createDataFrame([full, bare, *bad], TRIP)).collect()}
    assert set(found) == {"t", "u"}
    t, u = found["t"], found["u"]
    assert (t["end"], t["event_ids"], t["buffer"], t["extra"]) == ("2024-03-02", ["e", "f"], 720, 7)
    assert [b["amount"] for b in t["budget"]] == [0] and [(c["id"], c["source"]) for c in t["checklist"]] == [("k", None)] and [c["date"] for c in t["custom"]] == ["2024-02-29"]
    assert [(x["id"], x["minutes"]) for x in t["legs"]] == [("1", 5), ("4", None), ("6", 5)]
    assert (u["end"], u["buffer"], u["budget"], u["legs"]) == ("2024-03-09", 90, [], [])
    assert trips.normalised(spark.createDataFrame([], TRIP)).count() == 0


def test_leads(spark):
    rows = [("a", None, "x", None, None), ("b", None, " ", None, None), ("c", "nonsense", "x", None, None), ("d", "https://x.com/a", None, "matched", None), ("e", "https://x.com/a", None, "matched", "m"), (None, None, "x", None, None)]
    found = trips.leads(spark.createDataFrame(rows, "id string, url string, pasted string, status string, event_id string")).collect()
    assert {(r["id"], r["status"]) for r in found} == {("a", "inbox"), ("e", "matched")}


def test_offers_of_phases(spark):
    phases = [("e", "https://a.jp/x#top", "resale", "closed", "2024-01-01", "2024-01-02"), ("e", "https://a.jp/x", "general", "open", "2024-02-01", "2024-02-02"), ("e", "https://a.jp/x", "fc_lottery", "open", "2024-01-05", None),
              ("e", "https://a.jp/help/1", "general", "open", "2024-01-01", None), ("e", None, "general", "open", None, None)]
    links = [("e", "https://a.jp/x"), ("e", "https://a.jp/y?utm_source=b"), ("e", "not a link"), ("e", None)]
    out = trips.offers_of_phases(spark.createDataFrame(phases, "event_id string, url string, kind string, status string, start string, end string"), spark.createDataFrame(links, "event_id string, url string")).collect()
    assert {(r["url"], r["sale_type"], r["sale_status"], r["start_at"], r["end_at"]) for r in out} == {
        ("https://a.jp/x", "fan_club_lottery", "open", "2024-01-05T00:00:00+09:00", None), ("https://a.jp/y", "other", "unknown", None, None),
    }


def test_names_and_paths(spark):
    got = one(
        spark, plain=checks.act_name(F.lit("  A 　 B ")), empty=checks.act_name(F.lit(None).cast("string")), role=checks.act_name(F.lit("X ギター")), open=checks.act_name(F.lit("X (a")), long=checks.act_name(F.lit("x" * 41)), many=checks.act_name(F.lit("(a)(b)")),
        mc=checks.act_name(F.lit("MC Taro")), none=checks.act_rejection(F.lit("A"), F.lit(1), F.lit(1)), page=checks.act_rejection(F.lit("Osaka"), F.lit(1), F.lit(1)), source=checks.act_rejection(F.lit("Osaka"), F.lit(None), F.lit(1)),
        cased=checks.act_rejection(F.lit("a W"), F.lit(1), F.lit(1)), path=checks.path_segment(F.lit("／Ａ b／")), nothing=checks.path_segment(F.lit("／／")), absent=checks.path_segment(F.lit(None).cast("string")), kind=checks.file_kind(F.lit(None).cast("string")),
    )
    want = {"plain": "A B", "none": None, "page": "page_label_not_artist", "source": "missing_official_source", "cased": None, "path": "A-b", "nothing": "unknown", "absent": "unknown", "kind": "bin"}
    assert got == dict.fromkeys(("empty", "role", "open", "long", "many", "mc")) | want


def test_days_left(spark):
    at = lambda s: checks.days_left_label(F.lit("2024-03-01"), F.lit(s).cast("timestamp"))
    got = one(spark, past=at("2024-03-01 15:00:00"), today=at("2024-03-01 14:00:00"), tomorrow=at("2024-02-29 14:00:00"), later=at("2024-02-20 00:00:00"), no=checks.days_left_label(F.lit("x"), F.lit("2024-01-01").cast("timestamp")))
    assert got == {"past": "已截止", "today": "今天截止", "tomorrow": "明天截止", "later": "还剩 10 天", "no": None}


def test_decide(spark):
    schema = "id string, issues array<string>, fields array<struct<name string, availability string, approval string>>, evidence_hash string, rejected boolean, approved boolean, approved_hash string"
    rows = [("ok", ["odd"], [("title", "published", "approved")], "h", None, True, "h"), ("stale", [], [], "h", False, True, "g"), ("bare", [], [], "h", False, True, None), ("both", [], [], "h", True, True, "h"), ("field", [], [("venue", "blocked", "pending"), ("note", "blocked", "pending")], "h", False, None, None)]
    got = {r["id"]: (r["state"], r["primary_reason"], r["issues"]) for r in review.decide(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "ok": ("approved", None, ["odd"]), "stale": ("candidate", "field_review_pending", ["approval_stale", "field_review_pending"]), "bare": ("candidate", "field_review_pending", ["approval_requires_evidence_hash", "field_review_pending"]),
        "both": ("rejected", "rejected", ["rejected"]), "field": ("candidate", "required_field:venue:blocked:pending", ["required_field:venue:blocked:pending"]),
    }


def test_take_over(spark):
    ledger = spark.createDataFrame([("a", {"x": "1", "y": "2"}, "r", None), ("b", {"x": "1"}, "r", None)], "event_id string, fields map<string,string>, reviewer string, verified_at timestamp")
    batch = spark.createDataFrame([("a", {"y": "3", "z": "4"}), ("c", {})], "event_id string, fields map<string,string>")
    got = {r["event_id"]: (r["fields"], r["reviewer"]) for r in review.take_over(ledger, batch, "s", F.current_timestamp()).collect()}
    assert got == {"a": ({"x": "1", "y": "3", "z": "4"}, "s"), "b": ({"x": "1"}, "r"), "c": ({}, "s")}
    yes, no = review.decisions(spark.createDataFrame([("a", "approve", "h", None), ("b", "reject", None, "w"), ("c", None, None, None)], "id string, decision string, evidence_hash string, reason string"))
    assert [tuple(r) for r in yes.collect()] == [("a", "h")] and [tuple(r) for r in no.collect()] == [("b", "w")]


def test_addresses_are_taken_apart_once(spark):
    """Two readings of an address, before and after the aggregate, of four parts and a few more; filters must not repeat them."""
    phases = spark.createDataFrame([("e", "https://eplus.jp/sf/detail/1", "general", "open", "2026-01-01", "2026-01-02")], "event_id string, url string, kind string, status string, start string, end string")
    links = spark.createDataFrame([("e", f"https://eplus.jp{p}?utm_source=a") for p in ("/sf/detail/1/", "/sf/detail/2", "/help/x", "/refund/1")] + [("e", "tel:1"), ("e", None)], "event_id string, url string")
    out = trips.offers_of_phases(phases, links)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 20
    assert sorted((r.url, r.url_kind, r.provider, r.sale_status) for r in out.collect()) == [("https://eplus.jp/sf/detail/1", "event_detail", "eplus", "open"), ("https://eplus.jp/sf/detail/2", "event_detail", "eplus", "unknown")]
