"""The similarity join by count vectors against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from confluo.llm import queries, rtree

from ..oracle import connect, difference

SCHEMA = "doc_id long, text string, node long, point string, n_shingles int, a long, `first_id` string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 3, 4, "f", "c") for r in rows], SCHEMA).repartition(3)


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in rtree.similar_sets(frame(spark, rows), **how).collect()), key=repr)


def family(r, vocabulary, n, copies, edits):
    base = [r.choice(vocabulary) for _ in range(n)]
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(n)] = r.choice(vocabulary)
        yield " ".join(own)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeilmnorstuéß") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts = [t for _ in range(12) for t in family(r, vocabulary, r.choice([4, 25, 60, 120, 300]), r.choice([1, 3, 12]), 4)]
    texts += list(family(r, vocabulary, 100, 60, 3)) + list(family(r, vocabulary, 100, 60, 12))  # most linked; hardly any
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 12, 13, 14, 15, 80]))) for _ in range(80)]
    texts += [None, "", " \t\n", "one", "One", "one two", "two one", "a b c", "A\tb\nC", "x" * 30_000, "again " * 300, "ÄÖ ü 　 ✓", "ÄÖ ü 　 ✓ end"]
    texts += [" ".join(r.choice(vocabulary) for _ in range(9000))]
    texts += [texts[-1].replace(vocabulary[0], vocabulary[1]), texts[0].upper(), texts[0], texts[3]]
    rows = list(enumerate(texts))
    rows += [(None, texts[20]), (None, "lonely words here without an id"), (None, texts[20] + " more"), (5, texts[5]), (5, texts[5]), (7, texts[9]), (7, "another text under the same id")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"leaf": 16, "dealt": 60, "roots": 2}, {"leaf": 3, "dealt": 20, "roots": 1}])
def test_against_all_pairs(spark, monkeypatch, how):
    if how:  # many levels, blocks of few sets
        for name, value in (("CHILDREN", 4), ("PARTNERS", 2), ("STEP", 5), ("BLOCK", 4), ("MEMBERS", 9), ("PART", 7)):
            monkeypatch.setattr(rtree, name, value)
    rows = corpus(len(how))
    assert got(spark, rows, **how) == plain(rows)


def test_other_threshold_and_empty(spark):
    rows = corpus(7)
    assert got(spark, rows, percent=60) == plain(rows, 60)
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_bound_holds():
    """No pair of sets that is similar enough is dropped by counts, also where counts are held at their bounds."""
    r = np.random.default_rng(1)
    for n, percent in ((5, 90), (200, 90), (3000, 75), (120_000, 90)):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        sets = []
        for share in (0.0, 0.01, 0.04, 0.05, 0.06, 0.1, 0.5):
            other = base.copy()
            other[: int(share * n)] = r.integers(0, 2**63, int(share * n), dtype=np.uint64)
            sets.append(np.unique(other))
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        raw = np.frombuffer(b"".join(rtree.point(sets[i]) for i in order), np.uint8).reshape(len(sets), -1)
        words = np.ascontiguousarray(raw[:, : 2 * rtree.WORD_GROUPS])
        page = rtree.Page({"nodes": np.arange(len(sets)).tobytes(), "sizes": np.array([len(sets[i]) for i in order], np.int64).tobytes(), "words": words.tobytes(), "groups": np.ascontiguousarray(raw[:, 2 * rtree.WORD_GROUPS :]).tobytes()})
        first = rtree.met(page, page, percent)
        for x in range(len(order)):
            for y in range(x):
                both = len(np.intersect1d(sets[order[x]], sets[order[y]]))
                if 100 * both >= percent * (len(sets[order[x]]) + len(sets[order[y]]) - both):
                    assert first[x] == first[y]


def test_sets_and_leaves():
    texts = pa.array(["a b c d", "A B", None, "a b c a b c"])
    sets = rtree.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 1, 0, 3]
    assert len(np.intersect1d(sets[0], sets[3])) == 1
    r = np.random.default_rng(2)
    sizes, counts = r.integers(1, 50, 1000), r.integers(0, 9, (1000, 8))
    own = rtree.cut(sizes, counts, 60)
    assert sorted(np.concatenate(own).tolist()) == list(range(1000)) and max(map(len, own)) <= 60
    assert all(len(x) for x in rtree.cut(np.ones(10), np.ones((10, 8)), 1))


def test_query_against_sql(spark, small):
    assert difference(queries.op12_similar_sets(spark, small), connect(small), rtree.ORACLE_SQL) == ""
