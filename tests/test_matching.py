"""Observations against every event, one pair after the other."""

import random

import pytest

from confluo.operators import resolution

KIND = "date string, venue_name string, start_time string, title string, artist_names array<string>"


def overlap(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    return len(set(a) & set(b)) / max(len(set(a)), len(set(b)))


def score(o, e):
    agree = [bool(o[0]) and o[0] == e[0], overlap(o[1], e[1]) >= 0.75, bool(o[2]) and o[2] == e[2], any(overlap(x, y) >= 0.75 for x in o[4] or [] for y in e[4] or []), overlap(o[3], e[3]) >= 0.6]
    total = 0.0
    for yes, w in zip(agree, (0.35, 0.3, 0.15, 0.15, 0.05), strict=True):
        total += w if yes else 0.0
    return total, agree


def plain(observations, events, hints):
    out = {}
    for i, o in observations:
        rated = [(*score(o, e), k, e) for k, e in events]
        same = [r for r in rated if r[1][0] and r[1][1]]
        timed = [r for r in same if r[1][2]]
        hint = next((r for r in rated if r[2] == hints.get(i)), None)
        if hint is not None and hint[0] >= 0.65:
            crowd = [e for _, e in events if hint[3][0] and hint[3][1] and e[0] == hint[3][0] and overlap(e[1], hint[3][1]) >= 0.75]
            if not (len(crowd) > 1 and hint[3][2]) or o[2] == hint[3][2]:
                out[i] = (hint[2], "confirmed", "source_chain_match", hint[0])
                continue
        best = min(((-s, k) for s, _, k, _ in rated), default=(0, None))
        if len(same) == 1:
            out[i] = (same[0][2], "confirmed", "date_venue", same[0][0])
        elif len(same) > 1 and len(timed) == 1:
            out[i] = (timed[0][2], "confirmed", "date_venue_time", timed[0][0])
        elif -best[0] >= 0.45:
            out[i] = (best[1], "probable", "ambiguous_same_day_venue" if len(same) > 1 else "light_score", -best[0])
        else:
            out[i] = (None, "unmatched", "insufficient_evidence", -best[0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    names = ["zepptokyo", "zepptokyo1", "zeppnagoya", "bluearena", "areanblue", "hall", "hallx", "横浜アリーナ", "横浜ありーな", None, ""]
    acts = ["ado", "adoo", "yonezu", "perfume", "perfumer", "x", "椎名林檎", ""]
    titles = ["tour", "tour2026", "live in tokyo", "live tokyo", "fes", None, ""]
    one = lambda: (r.choice(["2026-01-01", "2026-01-02", "2026-01-03", None, ""]), r.choice(names), r.choice(["18:00", "19:00", "", None]), r.choice(titles), r.choice([None, [], [r.choice(acts)], [r.choice(acts), r.choice(acts), None]]))
    events, observations = [(f"e{i:03}", one()) for i in range(70)], [(i, one()) for i in range(250)]
    hints = {i: f"e{r.randrange(90):03}" for i, _ in observations if r.random() < 0.4}
    clean = lambda rows: [(k, (x[0], x[1], x[2], x[3], [a for a in x[4] if a] if x[4] else x[4])) for k, x in rows]
    got = resolution.match_observations(spark.createDataFrame([(i, *o, hints.get(i)) for i, o in observations], f"obs_id int, {KIND}, hint_id string"), spark.createDataFrame([(k, *e) for k, e in events], f"id string, {KIND}"))
    have = {x.obs_id: (x.event_id, x.level, x.reason, x.score) for x in got.collect()}
    want = plain(clean(observations), clean(events), hints)
    assert {i: (have[i], want[i]) for i in want if have[i] != want[i]} == {}


def test_one_crowded_day(spark):
    """Many events and observations of one date: what they meet by grows with both, not with their product."""
    events = [(f"e{i:04}", "2026-01-01", f"stage {i % 7}", f"{i % 24:02}:00", f"act {i}", [f"act {i}"]) for i in range(700)]
    seen = [(i, "2026-01-01", f"stage {i % 7}", f"{i % 24:02}:00", f"act {i}", [f"act {i}"]) for i in range(700)]
    got = resolution.match_observations(spark.createDataFrame(seen, f"obs_id int, {KIND}"), spark.createDataFrame(events, f"id string, {KIND}"))
    assert got.filter("score > 0.9 and level <> 'unmatched'").count() == 700


def test_no_events(spark):
    got = resolution.match_observations(spark.createDataFrame([(1, "2026-01-01", "hall", None, None, None)], f"obs_id int, {KIND}"), spark.createDataFrame([], f"id string, {KIND}"))
    assert [tuple(x) for x in got.collect()] == [(1, None, "unmatched", "insufficient_evidence", 0.0)]
