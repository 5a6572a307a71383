"""Assembly of events and migration of reviews: all or nothing."""

import hashlib

import pytest

from confluo.operators import assembly

FIELD = {"availability_status": "published", "approval_state": "approved", "approval_hash": "h", "evidence": []}
CANDIDATE = {
    "id": "e1", "review_state": "approved", "ready_for_review": True, "required_fields_approved": True, "evidence_hash": "eh", "sources": [("hall", "venue_official", "https://x.example/", "t")], "title": "found", "artist_ids": ["a"], "artist_names": ["A"], "venue_id": "v", "date": "2026-09-01", "open_time": "17:00", "start_time": "18:00", "prices_jpy": [9000],
    "fields": None,
}


def candidates(spark, *own):
    return spark.createDataFrame([CANDIDATE | r for r in own], assembly.CANDIDATE)


def published(spark, *own):
    return [r.asDict(recursive=True) for r in assembly.publish(candidates(spark, *own), "now", "2026-06-01").orderBy("id").collect()]


def fields(**values):
    names = {"title": '"t"', "artist": '["b"]', "venue": '"w"', "eventDate": '"2026-05-01"', "openTime": '"10:00"', "startTime": '"11:00"'}
    return {n: FIELD | {"value": v, "approval_hash": f"h{n}"} for n, v in (names | values).items()}


def test_values_are_those_approved(spark):
    plain, by_field = published(spark, {}, {"id": "e2", "fields": fields(prices="[5,6]")})
    assert (plain["title_ja"], plain["venue_id"], plain["event_status"], plain["verification"]["evidence_hash"], plain["field_provenance"]) == ("found", "v", "scheduled", "eh", None)
    assert plain["tiers"] == [{"name": "官方公布票价", "price_jpy": 9000, "tax_included": None, "note": None}]
    assert (by_field["title_ja"], by_field["artist_ids"], by_field["venue_id"], by_field["date"], by_field["event_status"], by_field["status"]) == ("t", ["b"], "w", "2026-05-01", "completed", "ended")
    assert [(t["name"], t["price_jpy"]) for t in by_field["tiers"]] == [("官方公布票价 1", 5), ("官方公布票价 2", 6)]
    want = sorted(f"h{n}" for n in fields(prices="[]"))
    assert by_field["verification"]["evidence_hash"] == hashlib.sha256("|".join(want).encode()).hexdigest()
    assert "value" not in by_field["field_provenance"]["title"] and by_field["availability"]["prices"] == "published"


def test_unapproved_or_unpublished_values_are_left_out(spark):
    for change in ({"approval_state": "pending_review"}, {"availability_status": "not_found_on_page"}):
        own = fields(prices="[5]", purchaseUrls='["https://t.example/"]')
        own["prices"] = own["prices"] | change
        [event] = published(spark, {"fields": own, "ticket_urls": ["https://other.example/"]})
        assert event["tiers"] == [] and [x["url"] for x in event["ticket_links"]] == ["https://t.example/"]


def test_tiers_phases_links_and_offers(spark):
    row = {"ticket_types": [("S", 1000, True, ["a", "b"]), ("", 2000, None, []), (None, None, None, None)], "ticket_phases": [("p", "fc_lottery", "2026-05-01", "2026-06-01", "https://eplus.jp/sf/detail/1"), ("q", "general", "2026-07-01", "2026-07-02", None)], "ticket_urls": ["https://eplus.jp/sf/detail/1", "https://x.example/"]}
    made = assembly.publish(candidates(spark, row), "now", "2026-06-01")
    event = made.first().asDict(recursive=True)
    assert [(t["name"], t["note"]) for t in event["tiers"]] == [("S", "a · b"), ("官方公布票价 2", None), ("官方公布票价 3", None)]
    assert [p["status"] for p in event["phases"]] == ["open", "upcoming"] and event["status"] == "lottery"
    assert [x["label"] for x in event["ticket_links"]] == [assembly.SALE_LABEL, assembly.PAGE_LABEL]
    assert {(r.url, r.sale_status) for r in assembly.event_offers(made).collect()} >= {("https://eplus.jp/sf/detail/1", "open")}


@pytest.mark.parametrize(
    ("change", "why"),
    [({"review_state": "candidate"}, assembly.NOT_READY), ({"ready_for_review": None}, assembly.NOT_READY), ({"sources": []}, assembly.NOT_READY), ({"sources": None}, assembly.NOT_READY), ({"evidence_hash": ""}, assembly.NOT_READY), ({"open_time": None}, assembly.NOT_READY), ({"sources": [("f", "blog", "u", "t")]}, assembly.UNTRACED), ({"artist_ids": []}, assembly.UNAPPROVED), ({"title": ""}, assembly.UNAPPROVED),
     ({"fields": fields(), "required_fields_approved": False}, assembly.NOT_READY), ({"fields": fields(venue="null")}, assembly.UNAPPROVED), ({"fields": fields(artist="[]")}, assembly.UNAPPROVED)],
)
def test_one_unfit_candidate_refuses_all(spark, change, why):
    with pytest.raises(ValueError, match=f"e2: {why}"):
        assembly.publish(candidates(spark, {}, {"id": "e2"} | change), "now", "2026-06-01")


def test_migration(spark):
    own = candidates(spark, {"fields": fields()}, {"id": "e2", "fields": fields() | {"prices": FIELD | {"approval_hash": None}}, "artist_ids": ["x", "y"]})
    event = {"id": "e1", "title_ja": "found", "artist_ids": ["a"], "venue_id": "v", "date": "2026-09-01", "open_time": "17:00", "start_time": "18:00"}
    schema = "id string, title_ja string, artist_ids array<string>, venue_id string, date string, open_time string, start_time string"
    events = lambda *rows: spark.createDataFrame([event | r for r in rows], schema)
    got = assembly.migrate_reviews(events({}, {"id": "e2", "artist_ids": ["y", "x"]}), own, "now").orderBy("id").collect()
    assert [(r.id, r.verified_at, len(r.fields)) for r in got] == [("e1", "now", 6), ("e2", "now", 6)]
    for bad, why in (({"id": "e3"}, "e3: no candidate"), ({"venue_id": "w"}, "e1: identity differs: venue_id"), ({"start_time": None, "artist_ids": None}, "artist_ids,start_time")):
        with pytest.raises(ValueError, match=why):
            assembly.migrate_reviews(events({"id": "e2", "artist_ids": ["x", "y"]}, bad), own, "now")
    with pytest.raises(ValueError, match="no candidate with fields"):
        assembly.migrate_reviews(events({}), candidates(spark, {}), "now")
