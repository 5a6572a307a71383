"""Search over several fields against a plain table of distances for every text."""

import math
import random

from pyspark.sql import functions as F

from confluo.operators import search

FIELDS = {"name": 2.0, "tags": 1.5, "place": 1.0}


def edits(pattern, text):
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row, least = new, min(least, new[-1])
    return least


def normal(x):
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in (x or "").lower().strip())


def plain(pattern, items, threshold, n):
    whole, out = normal(pattern), []
    if not whole:
        return []
    parts = [whole] if len(whole) <= 32 else [whole[min(i, len(whole) - 32) :][:32] for i in range(0, len(whole), 32)]
    for item, seq, values in items:
        total, hit = 0.0, False
        for name, weight in FIELDS.items():
            v = values.get(name)
            for t in v if isinstance(v, list) else [v]:
                t = normal(t)
                if not t:
                    continue
                errors = [edits(p, t) / len(p) for p in parts]
                if t == whole:
                    score = 2.220446049250313e-16
                elif any(e <= threshold for e in errors):
                    score = sum(max(0.001, e) if e <= threshold else 1.0 for e in errors) / len(parts)
                else:
                    continue
                norm = math.floor(1000 / math.sqrt(len([x for x in t.split(" ") if x])) + 0.5) / 1000
                total, hit = total + weight / sum(FIELDS.values()) * norm * math.log(score), True
        if hit:
            out.append((round(math.exp(total), 9), seq, item))
    return [i for _, _, i in sorted(out)[:n]]


def test_distances_bit_parallel():
    r = random.Random(1)
    for _ in range(300):
        letters = r.choice(["ab", "abc ", "aあé😀"])
        p = "".join(r.choice(letters) for _ in range(r.choice([1, 2, 5, 31, 32])))
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(5)]
        assert search.distances(p, texts).tolist() == [edits(p, t) for t in texts], (p, texts)


def test_against_plain_search(spark):
    r = random.Random(4)
    words = ["ring", "rings", "Ringo", "キングヌー", "きんぐ", "small", "smal", "blue sky", "x", "横浜アリーナ", "a b c d", "Zepp Sapporo", "the long hall of many names in one long field of words"]
    items = []
    for i in range(120):
        slip = list(r.choice(words) + r.choice(["", " " + r.choice(words)]))
        slip[r.randrange(len(slip))] = r.choice("abキ ")
        items.append((f"i{i}", i // 3, {"name": "".join(slip), "tags": [r.choice(words) for _ in range(r.randint(0, 2))], "place": r.choice([None, "", " ", *words])}))
    df = spark.createDataFrame([(i, s, v["name"], v["tags"], v["place"]) for i, s, v in items], "id string, seq int, name string, tags array<string>, place string").repartition(3)
    asked = ["ring", "RINGS ", "キング", "きんぐぬー", "smll", "x", "yokohama", "アリーナ", "", None, "zep saporo", "the long hall of many nammes in one long field of wrds", "a long hall of many names in one lo", "q", "a b"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, pattern string")
    for threshold, n in ((0.32, 5), (0.3, 6), (0.0, 4)):
        got = {}
        for x in search.best(search.matches(queries, search.field_rows(df, FIELDS), threshold), n).orderBy("query", "place").collect():
            got.setdefault(x["query"], []).append(x["item"])
        for i, p in enumerate(asked):
            assert got.get(i, []) == plain(p, items, threshold, n), (p, threshold)


def test_errors_within_a_share(spark):
    df = spark.range(1, 33).select(search.most_errors(F.col("id"), 0.32).alias("k"), "id")
    assert all(r.k / r.id <= 0.32 < (r.k + 1) / r.id for r in df.collect())


def test_events_of_the_best_artist(spark):
    artist = "id string, seq int, name_ja string, name_zh string, romaji string, kana string, aliases array<string>"
    artists = spark.createDataFrame([("a", 0, "Aimer", None, None, None, []), ("b", 1, "Aimers", None, None, None, None)], artist)
    venues = spark.createDataFrame([], "id string, seq int, name_ja string, name_zh string, city string")
    rows = [(f"e{i}", i, "Aimer live" if i in (3, 7) else f"other {i}", None, None, ["a", "a"] if i % 2 else ["b"]) for i in range(40)]
    events = spark.createDataFrame(rows, "id string, seq int, title_ja string, title_zh string, tour_name string, artist_ids array<string>")
    queries = spark.createDataFrame([(1, "aimer"), (2, "nothing like it")], "query int, pattern string")
    got = [(r.kind, r.place, r.id) for r in search.search_all(queries, artists, venues, events).orderBy("kind", "place").collect()]
    assert got == [("artist", 1, "a"), ("artist", 2, "b"), *[("event", i + 1, f"e{x}") for i, x in enumerate([3, 7, 1, 5, 9, 11])]]


def test_blocks_lose_no_match():
    r = random.Random(7)
    texts = ["".join(r.choice("abcd é😀") for _ in range(r.randint(1, 40))) for _ in range(300)]
    own = search.blocks(texts)
    for _ in range(60):
        t, n = r.choice(texts), r.randint(1, 32)
        slip = list(t[:n])
        slip[r.randrange(len(slip))] = r.choice("abx")
        p = "".join(slip)
        for k in (0, int(0.32 * len(p)), len(p) // 2):
            got = {b.texts[i]: int(e) for b in own for i, e in zip(*b.near(p, k), strict=True)}
            assert got == {x: e for x in texts if (e := edits(p, x)) <= k}, (p, k)


def test_equal_patterns_are_asked_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "tiles", lambda patterns, texts, f=search.tiles: seen.append(patterns.count()) or f(patterns, texts))
    artists = spark.createDataFrame([(f"a{i}", i, "Aimer", None, None, None, None) for i in range(9)], "id string, seq int, name_ja string, name_zh string, romaji string, kana string, aliases array<string>")
    venues = spark.createDataFrame([], "id string, seq int, name_ja string, name_zh string, city string")
    events = spark.createDataFrame([], "id string, seq int, title_ja string, title_zh string, tour_name string, artist_ids array<string>")
    queries = spark.createDataFrame([(i, " AIMER" if i % 2 else "aimer") for i in range(50)], "query int, pattern string")
    assert search.search_all(queries, artists, venues, events).count() == 50 * 5 and seen == [1, 1, 1]
