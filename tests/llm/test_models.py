"""Features, trees, lookups, likeness and gradients against plain versions of their definitions."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from confluo.llm import gam, hosts, langid, multiset, words

from .test_operators import ROWS

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_features(text):
    """The features of a text, one by one."""
    data = (text or "").encode()
    own = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n, size = max(1, len(own)), max(1, len(data))
    lengths = [len(w) for w in own]
    mean = sum(lengths) / n
    count = lambda chars: sum(b in chars for b in data)
    upper, lower = range(65, 91), range(97, 123)
    n_upper, n_lower = count(upper), count(lower)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    letter = lambda w: any(b in upper or b in lower or b >= 128 for b in w)
    return [
        math.log1p(len(own)), mean, math.sqrt(max(0, sum(x * x for x in lengths) / n - mean**2)), math.log1p(max(lengths, default=0)), count(b"#*$%&|<>=@^_~{}[]\\/") / size, count(b"!\"'(),-.:;?") / size, count(b"!") / size, n_upper / max(1, n_upper + n_lower), count(b"0123456789") / size,
        sum(not letter(w) for w in own) / n, len(set(own)) / n, max((own.count(w) for w in set(own)), default=0) / n, sum(a == b for a, b in zip(own, own[1:], strict=False)) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(lines) / n, sum(w.endswith(b".") for w in own) / n, (n_upper + n_lower) / size,
    ]


def test_text_features():
    texts = [t for _, t, *_ in ROWS if not t or len(t) < 5000]
    have = gam.text_features(pa.array(texts, pa.string()))
    assert np.allclose(have, [plain_features(t) for t in texts], atol=1e-9)


def test_shallow_trees():
    """The first cut is the best of all cuts, and every leaf has the shrunk mean of its bins."""
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(2, 12))
        g, h = r.normal(size=n), r.random(n) + 0.1
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.5)
        gains = [worth(0, i) + worth(i, n) - worth(0, n) for i in range(1, n)]
        gain, at = gam.best_cut(g, h, 1.5)
        assert np.isclose(gain, max(gains)) and at == 1 + int(np.argmax(gains))
        out = gam.shallow_tree(g, h, 1.5, leaves=4)
        cuts = [0, *(np.flatnonzero(np.diff(out)) + 1).tolist(), n]
        assert len(cuts) - 1 <= 4
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert np.allclose(out[a:b], g[a:b].sum() / (h[a:b].sum() + 1.5))


def test_lookups():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(500, 4)), (r.random(500) > 0.4).astype(float)
    x[:100, 0] = 0.5  # ties at a cut
    m = gam.train(x, y, rounds=5, pair_rounds=3)
    for i in (0, 3, 17, 250, 499):
        total = m.base + sum(m.tables[j][sum(e <= x[i, j] for e in m.edges[j])] for j in range(4))
        total += sum(t[sum(e <= x[i, a] for e in m.pair_edges[a]), sum(e <= x[i, b] for e in m.pair_edges[b])] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
        assert np.isclose(m.logits(x)[i], total)


def test_host_squares_do_not_overflow(spark):
    rows = spark.range(1).selectExpr("explode(array('a', 'b')) _host", "true failed").crossJoin(spark.range(3)).select("_host", "failed")
    assert hosts.host_rates(rows).count() == 2
    assert spark.sql("select cast(4000000000L as double) * 4000000000L / 2 > 0").first()[0]


def units_of(text):
    return sorted(u for p in text.encode().split(b"\n") for u in multiset.units(p))


def test_likeness_follows_shared_units():
    """The estimate against the true share of units, over many pairs: no bias beyond a few hundredths."""
    from collections import Counter

    r = random.Random(7)
    sentence = lambda: " ".join("".join(r.choice("bcdfghjklm") for _ in range(5)) for _ in range(6)) + "."
    off = []
    for _ in range(120):
        own = [sentence() for _ in range(r.randint(40, 90))]
        other = own[: r.randint(0, len(own))] + [sentence() for _ in range(r.randint(0, 30))]
        r.shuffle(other)
        a, b = "\n".join(own), "\n".join(other) or "x."
        ca, cb = Counter(units_of(a)), Counter(units_of(b))
        apart = sum(((ca - cb) + (cb - ca)).values())
        want = 1 - apart / (sum(ca.values()) + sum(cb.values()))
        off.append(multiset.likeness(multiset.vectors([a]), multiset.vectors([b]))[0] - max(0, want))
    assert abs(np.mean(off)) < 0.04 and np.sqrt(np.mean(np.square(off))) < 0.12


def plain_grams(word):
    """Buckets of a word's n-grams of 2 to 4 bytes within its marks, and of its affixes of 1 to 3 bytes."""
    data, out = [1, *word.encode(), 2], []
    mix = lambda x: int(words.mix64(np.array([x % 2**64], np.uint64))[0]) % langid.BUCKETS
    for k in (2, 3, 4):
        for i in range(len(data) - k + 1):
            code = data[i]
            for b in data[i + 1 : i + k]:
                code = code * 257 + b
            out.append(mix(code + (k << 56)))
    inner = data[1:-1]
    for k in (1, 2, 3):
        if len(inner) >= k:
            for side, part in ((1, inner[:k]), (2, inner[-k:])):
                code = k
                for b in part:
                    code = code * 257 + b
                out.append(mix(code + (side << 60)))
    return sorted(out)


def test_repeated_units():
    """A line that both say over and over counts on both sides: the likeness stays that of what is said."""
    line = "the same line again.\n"
    like = lambda a, b: multiset.likeness(multiset.vectors([a]), multiset.vectors([b]))[0]
    assert like(line * 100, line * 90) > 0.95 and like(line * 100, "another thing altogether.\n" * 100) < 0.2 and like(line * 100, "") < 0.2
    assert multiset.units(b"one. two? three") == [b"one. ", b"two? ", b"three"] and multiset.units(b"one.") == [b"one."]


def test_gram_features():
    own = ["a", "ab", "straße", "über", "x" * 30, "", "don't"]
    bucket, places = langid.gram_features(pa.array(own))
    assert [sorted(bucket[a:b].tolist()) for a, b in zip(places, places[1:], strict=False)] == [plain_grams(w) for w in own]


def log_likelihood(p, gold, t):
    """Of one sequence of labels, by the forward recursion. The first label is as likely as any, then steps by t."""
    k = p.shape[1]
    v = np.full(k, 1 / k)
    total = 0.0
    for x in p:
        v = (v @ t) * x
        total += np.log(v.sum())
        v /= v.sum()
    own = np.log(np.full(k, 1 / k) @ t)[gold[0]] + np.log(p[0, gold[0]])
    own += sum(np.log(t[a, b]) for a, b in zip(gold, gold[1:], strict=False)) + sum(np.log(p[i, g]) for i, g in list(enumerate(gold))[1:])
    return own - total


def test_gradients():
    """Slopes of emissions and transitions against differences of the log-likelihood."""
    r = np.random.default_rng(3)
    scores, w, gold = r.normal(size=(6, 3)), r.normal(size=(3, 3)) * 0.4, r.integers(0, 3, 6)
    f = lambda s, u: log_likelihood(np.exp(s), gold, np.exp(u))
    marginals = langid.forward_backward(np.exp(scores).astype(np.float32), np.array([0, 6]), np.exp(w).astype(np.float32))
    slope, eps = np.eye(3)[gold] - marginals, 1e-5
    for i in range(6):
        for j in range(3):
            d = np.zeros_like(scores)
            d[i, j] = eps
            assert np.isclose((f(scores + d, w) - f(scores - d, w)) / (2 * eps), slope[i, j], atol=2e-3)
    steps = langid.pair_slope(np.exp(scores).astype(np.float32)[None], gold[None], np.exp(w).astype(np.float32))
    inside = lambda u: f(scores, u)
    first = np.full(3, 1 / 3)
    for a in range(3):
        for b in range(3):
            d = np.zeros_like(w)
            d[a, b] = eps
            # The step into the first word counts for no pair, so its part is taken off.
            enter = lambda u: np.log(first @ np.exp(u))
            entering = ((enter(w + d) - enter(w - d)) / (2 * eps) * (np.eye(3)[gold[0]] - marginals[0])).sum()
            assert np.isclose((inside(w + d) - inside(w - d)) / (2 * eps) - entering, steps[a, b], atol=3e-3)


def test_learning_uses_whole_texts():
    """Words at the end of long texts are learned, too."""
    head = "alpha beta gamma delta " * 100
    rows = [head + "zweigung"] * 6, [head + "plusieur"] * 6
    s = langid.Sample.of(pa.array([*rows[0], *rows[1], None, ""]), ["de"] * 6 + ["fr"] * 6 + ["de", "fr"])
    assert len(s.labels) == 12 and s.docs[-1] == len(s.codes) == 12 * 401
    m = langid.train(s, batches=2)
    assert {"zweigung", "plusieur"} <= set(m.lexicon.to_pylist())
