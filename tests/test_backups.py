"""Backups by section: which member of an id counts, and what is applied."""

from confluo.sources import backups


def test_sections(spark):
    known = spark.createDataFrame([("event", "e1"), ("event", "e2"), ("artist", "a1"), ("event", "a2")], "kind string, id string")
    rows = [
        (1, '{"plans":[{"eventId":"e1","n":1},{"eventId":"e1","n":2},{"eventId":"x"},{"n":3},null],"wants":["e2"],"follows":["a1","a2","a1"],"trips":[{"id":"t","v":1,"eventIds":["e1","x","y"]},{"id":"t","v":2},{"eventIds":["z"]}]}'),
        (2, '{"wants":["e2","e2","a1"],"follows":{"a":1}}'), (3, "not json"), (4, None), (5, '{"follows":[],"trips":[{}]}'),
    ]
    kept, found = backups.sections(spark.createDataFrame(rows, "backup_id int, body string"), known)
    got = {(r.backup_id, r.section): (r.restored, r.ignored, r.apply, r.reason) for r in found.collect()}
    assert got == {
        (1, "plans"): (1, 4, True, None), (1, "follows"): (1, 2, True, None), (1, "trips"): (1, 4, True, None), (2, "wants"): (1, 2, True, None), (2, "follows"): (0, 1, False, "follows" + backups.NO_LIST), (5, "follows"): (0, 0, True, None), (5, "trips"): (0, 1, False, backups.NOTHING_VALID),
    }
    assert sorted((r.backup_id, r.section, r.id, r.item) for r in kept.collect()) == [(1, "follows", "a1", "a1"), (1, "plans", "e1", '{"eventId":"e1","n":2}'), (1, "trips", "t", '{"id":"t","v":2}'), (2, "wants", "e2", "e2")]
