"""The matrix of verified fields."""

from confluo.operators import verification as v

EVENT = "id string, checked_at string, source_urls array<string>"


def test_fields(spark):
    offer = {"event_id": "e1", "seq": 1, "url": "https://t/1", "source_url": "https://s/1", "url_kind": "event_detail", "provider_label": "e+", "sale_status": "open", "last_verified_at": "2026-08-31T00:00:00.000Z"}
    offers = lambda *rows: spark.createDataFrame([offer | r for r in rows], v.OFFER)
    events = spark.createDataFrame([("e1", "2026-08-30T00:00:00Z", ["https://a/1"]), ("e2", None, None)], EVENT)
    before = offers({})
    after = offers({"start_at": "2026-09-01", "requires_japanese_phone": False, "region_restriction": "unknown", "eligibility": ["a", "b"]}, {"seq": 2, "url": "https://t/2", "url_kind": "search", "eligibility": ["b", "c"], "last_verified_at": "never", "identity_check": True}, {"seq": 3, "url_kind": "support", "ticket_app": "x"})
    found = spark.createDataFrame([("e1", "end_at"), ("e1", "start_at"), ("e1", "ticket_app")], "event_id string, field string")
    rows = {(r.event_id, r.field): r for r in v.matrix(events, before, events, after, found).collect()}
    assert len(rows) == 28
    one = lambda f: rows["e1", f]
    assert (one("officialTicketPage").current_value, one("officialTicketPage").source_urls, one("officialTicketPage").changed) == ("https://s/1；https://t/1", "https://s/1；https://t/1", False)
    assert (one("eligibility").current_value, one("eligibility").source_urls, one("eligibility").changed) == ("a；b；c", "https://s/1；https://t/1；https://t/2", True)
    assert one("applicationWindow").current_value == "e+：2026-09-01 → 截止未说明" and one("applicationWindow").requires_manual and one("applicationWindow").n_conflicts == 2
    assert one("phoneRegion").current_value == "官方说明不需要日本手机号" and one("identityCheck").last_verified_at is None
    assert one("ticketApp").current_value is None and one("ticketApp").unknown_reason == v.UNDISCLOSED and one("ticketApp").requires_manual
    assert (one("officialEventDetail").current_value, one("officialEventDetail").last_verified_at) == ("https://a/1", "2026-08-30T00:00:00Z") and one("lastVerifiedAt").current_value == "2026-08-31T00:00:00.000Z"
    assert rows["e2", "officialEventDetail"].unknown_reason == v.REASONS["officialEventDetail"] and rows["e2", "lastVerifiedAt"].unknown_reason == v.REASONS["lastVerifiedAt"]


def test_offers_dealt_out_by_event_are_not_shuffled_again(spark):
    offers = spark.createDataFrame([{"event_id": "e1", "seq": i, "url": f"https://t/{i % 2}", "source_url": "https://s/1", "url_kind": "event_detail", "sale_status": "open", "provider_label": "e+"} for i in range(40)], v.OFFER).repartition("event_id")
    events = spark.createDataFrame([("e1", None, None)], EVENT)
    plan = v.held(events, offers)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the offers once, the events once
    row = plan.collect()[0]
    assert [o.seq for o in row.offers] == [0, 1]  # offers that say the same are one
