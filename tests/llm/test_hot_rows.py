"""A third of all rows under one id, without one, or copies of one row: right results, and no task that holds them all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from confluo.llm import minhash, mixing, multiset, packing, queries

from .test_operators import brute_components, plain_edited


def hot_rows():
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(3)) for _ in range(n))
    rows = [(i, text(r.randint(1, 30)), f"s{i % 3}") for i in range(1000, 1200)]
    rows += [(None, text(12), "s1") for _ in range(150)] + [(7, "the very same row again and again", "s2")] * 150 + [(9, text(12), None) for _ in range(150)]
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "doc_id long, text string, source string").repartition(5).cache()


def test_fingerprints(hot):
    out = multiset.edited_fingerprints(hot, rows_per_bucket=10)
    assert Counter(map(tuple, out.select("doc_id", "n_chars", "edited_sha256").collect())) == Counter(plain_edited([(i, t) for i, t, _ in hot_rows()]))
    sizes = [r[0] for r in multiset.with_next(hot, "doc_id", "text", 10).filter("extra = 0").groupBy("bucket").count().select("count").collect()]
    assert max(sizes) < 60 and sum(sizes) == len(hot_rows())


def test_fingerprints_of_other_ids(spark):
    rows = [(f"k{i % 40}" if i % 7 else None, f"text {i * 37 % 100} of it") for i in range(300)]
    out = multiset.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), rows_per_bucket=5)
    order = sorted(rows, key=lambda x: (x[0] is None, [-ord(c) for c in x[0] or ""] + [1], x[1]))
    want = Counter((a[0], len(a[1]), __import__("hashlib").sha256((a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode()).hexdigest()) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter(map(tuple, out.select("doc_id", "n_chars", "edited_sha256").collect())) == want


def brute_mix(rows, seed=17):
    """Words taken of each (id, source, size), by sorting each source whole."""
    import hashlib

    from .test_operators import WORD, filled

    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    out = Counter()
    for s in order:
        own = sorted((int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:12], 16), i is not None, i or 0, n) for i, src, n in sized if src == s)
        repeats = int(want[s] // sizes[s]) if sizes[s] else 0
        left = int(want[s] + 1e-9) - repeats * sizes[s]
        for _, has, i, n in own:
            extra = max(0, min(n, left))
            left -= extra
            out[i if has else None, s, n, repeats, extra] += 1
    return out


def test_mixing(hot):
    out = mixing.mix(hot.withColumn("place", F.lit(1)), weights=(3, 1, 2))
    have = Counter()
    of = {r["source_size"]: s for s, r in {r["source"]: r for r in hot.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))).alias("source_size")).collect()}.items()}
    for r in out.collect():
        have[r["doc_id"], of[r["source_size"]], r["size"], r["repeats"], r["extra"]] += 1
    assert have == brute_mix(hot_rows())


def test_repeat_is_by_row(spark, hot):
    """Rows of one id in two sources, or under no id, are decided each by itself; any column names."""
    have = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.repeat(hot.selectExpr("*", "1 as _id", "2 as _times", "3 as _copy", "4 as rank", "5 as size", "6 as place_at", "7 as row")).collect())
    want = Counter()
    for (i, s, n, repeats, extra), k in brute_mix(hot_rows()).items():
        want[i, s, n] += k * (repeats + (extra > 0))
    assert have == +want
    clash = hot.withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 as ROW_", "9 as h", "8 as place")
    assert mixing.repeat(clash).columns == clash.columns and mixing.repeat(clash.limit(0)).count() == 0
    two = spark.createDataFrame([(2, "a b c d", "x"), (2, "a b c d", "y"), (3, "a b", "y"), (4, "c", "x")], "doc_id long, text string, source string")
    taken = Counter((r["doc_id"], r["source"]) for r in mixing.repeat(two).collect())
    assert taken == Counter({(i, s): repeats + (extra > 0) for (i, s, n, repeats, extra), k in brute_mix([tuple(r) for r in two.collect()]).items() if repeats + (extra > 0)})


def test_near_duplicates(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        x = list(base)
        x[r.randrange(60)] = f"n{i}"
        rows.append((7 if i % 3 == 0 else None if i % 3 == 1 else i + 100, " ".join(x)))
    rows += [(7, " ".join(f"z{k}" for k in range(40))), (8, " ".join(f"z{k}" for k in range(1, 41))), (None, "quite alone here with five words")] + [(7, "copies of one text under one id")] * 50
    have = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, have.collect())) == Counter(brute_components(rows))


def test_parts_of_leaders_and_blocks(spark, monkeypatch):
    """Many members of one leader, and blocks that are cut in many parts, give the same components."""
    for name, value in (("PART", 4), ("BLOCK", 3), ("MEMBERS", 5), ("SHINGLES", 500)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(6)
    rows, own = [], [f"w{i}" for i in range(80)]
    for i in range(80):
        rows.append((i, " ".join(own)))
        own = own[2:] + [f"x{i}", f"y{i}"]
    for i in range(80, 160):
        x = [f"c{k}" for k in range(70)]
        for _ in range(3):
            x[r.randrange(70)] = f"n{i}{_}"
        rows.append((i, " ".join(x)))
    have = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, have.collect())) == Counter(brute_components(rows))


def test_packing_ranks_copies_in_parts(hot):
    pieces = packing.token_pieces(hot, queries.tokenizer(queries.WORDS), 4096, 1, "doc_id", "text", False).withColumn("row", F.monotonically_increasing_id()).cache()
    ranks = packing.ranked(pieces, "row").collect()
    of = {}
    for x in ranks:
        of.setdefault(x["length"], []).append(x["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in of.values())
    out = packing.pack(hot.withColumnRenamed("doc_id", "row"), queries.tokenizer(queries.WORDS), id_col="row")
    assert out.columns[0] == "row" and out.select("sequence_id", "offset").distinct().count() == len(hot_rows())
