from confluo.operators import resolution


def test_similar_venue_on_another_date(spark):
    kind = "date string, venue_name string, start_time string, title string, artist_names array<string>"
    events = spark.createDataFrame([("e1", "2026-01-01", "zepptokyo", "18:00", "a", ["abc"]), ("e2", None, "bluearena", "19:00", "b", ["xyz"]), ("e3", "2026-03-01", "hallx", "20:00", "c", None)], f"id string, {kind}")
    cases = [(1, "2026-05-05", "zepptokyo1", "18:00", None, ["abc"]), (2, "2026-05-05", "zepptoky", "18:00", None, ["abc"]), (3, None, "bluearena", "19:00", None, ["xyz"]), (4, "2026-05-05", "areanblue", None, "b", ["xyz"]), (5, "2026-05-05", "zzz", "18:00", "a", ["abc"]), (6, "2026-05-05", "hallx", None, "c", None)]
    found = resolution.match_observations(spark.createDataFrame(cases, f"obs_id int, {kind}"), events).collect()
    assert {r.obs_id: (r.event_id, r.level, r.score) for r in found if r.level != "unmatched"} == {1: ("e1", "probable", 0.6), 2: ("e1", "probable", 0.6), 3: ("e2", "probable", 0.6), 4: ("e2", "probable", 0.49999999999999994)}


def test_hinted_events(spark):
    kind = "date string, venue_name string, start_time string, title string, artist_names array<string>"
    events = spark.createDataFrame([("e1", "2026-01-01", "hall", "18:00", "a", ["x"]), ("e2", "2026-01-01", "hall", "13:00", "a", ["x"]), ("e3", "2026-02-02", "other", "18:00", "b", ["y"]), ("e4", "2026-03-03", "lone", "18:00", "c", ["z"])], f"id string, {kind}")
    cases = [
        (1, "2026-01-01", "hall", "13:00", "a", ["x"], "e2"), (2, "2026-01-01", "hall", None, "a", ["x"], "e2"), (3, "2026-01-01", "hall", "18:00", "a", ["x"], "e2"), (4, "2026-02-02", "other", "19:00", "b", ["q"], "e3"), (5, "2026-02-02", "other", "18:00", "b", ["y"], "nothing"), (6, "2026-03-03", "else", "18:00", "q", ["z"], "e4"),
        (7, "2026-03-04", "lone", "19:00", "q", ["q"], "e4"),
    ]
    found = resolution.match_observations(spark.createDataFrame(cases, f"obs_id int, {kind}, hint_id string"), events).collect()
    have = {r.obs_id: (r.event_id, r.reason) for r in found}
    assert have == {1: ("e2", "source_chain_match"), 2: ("e1", "ambiguous_same_day_venue"), 3: ("e1", "date_venue_time"), 4: ("e3", "source_chain_match"), 5: ("e3", "date_venue"), 6: ("e4", "source_chain_match"), 7: (None, "insufficient_evidence")}


def test_contained_by_rare_pieces(spark):
    """Against all pairs: names within variants and variants within names, short ones, and a piece that all share."""
    import random

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    names = ["common" + word(r.randint(0, 9)) for _ in range(60)] + [word(r.randint(1, 4)) for _ in range(20)]
    variants = [(i, "common" + word(r.randint(0, 4))) for i in range(30)] + [(40 + i, word(r.randint(3, 9))) for i in range(30)]
    have = {x["k"]: x["contained_id"] for x in resolution.contained(spark.createDataFrame(list(enumerate(names)), "k int, name string"), "k", "name", spark.createDataFrame(variants, "entity_id int, variant string")).collect()}
    want = {}
    for k, name in enumerate(names):
        fits = [(-len(v), i) for i, v in variants if len(v) >= 5 and (v in name or name in v)]
        if fits:
            want[k] = min(fits)[1]
    assert have == want
