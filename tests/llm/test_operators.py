"""The ten operators against brute-force versions, on odd rows and on a small corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confluo.llm import gam, hosts, langid, minhash, mixing, multiset, packing, pii, queries, tokens, warc, words
from confluo.llm.shared import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, signature string, length int, rank int, score double, `_host` string, bucket int, words string"


def corpus():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, repeated rows, odd characters."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abdeilmnorstuéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    text = lambda n: "\n".join(line(r.randint(5, 20)) + "." for _ in range(n))
    base, out = [text(r.randint(2, 12)) for _ in range(30)], []
    for i, b in enumerate(base):
        out.append((i, b, "en" if i % 2 else "de", f"s{i % 4}" if i % 7 else None))
    for i in range(30, 60):  # near copies and copies
        own = base[i % 10].split(" ")
        own[r.randrange(len(own))] = "changed"
        out.append((i, " ".join(own) if i % 3 else base[i % 10].upper(), "en", "s0"))
    out += [
        (60, None, None, "s0"), (61, "", "en", None), (62, " \t\n ", None, "s1"), (63, "one", "en", "s1"), (64, "one", "en", "s1"), (65, "mail a.b@c.example.org, +1 (234) 567-8901; 10.2.3.4", "en", "s2"),
        (66, text(900), "de", "s0"), (67, "x" * 30_000, "en", "s0"), (68, "😀 é ü 　 <|endoftext|> don't 4111 1111 1111 1111 ✓", None, "s3"), (None, base[0], "en", "s0"), (5, base[5], "en", "s1"), (5, base[5], "en", "s1"),
        (69, "same line here\n" * 40, "en", "s0"), (70, "again " * 400, "en", "s0"), (71, "a@b.c@d.e 999.1.1.1 +12-3456-789012345678 1234-5678 9012 3456 78", "en", "s2"),
    ]
    return out


ROWS = corpus()


def frame(spark, rows, schema=SCHEMA):
    extra = (7, 1, "x", 2, 3, 0.5, "h", 9, "w")
    return spark.createDataFrame([(*x, *extra) for x in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---- 1 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 256), (200, 16), (40, 4)])
def test_token_counts(docs, empty, chunk, overlap):
    import sentencepiece

    path = queries.tokenizer(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ROWS]
    assert got(tokens.token_counts(docs, path, chunk_chars=chunk, overlap=overlap)) == bag(want)
    assert tokens.token_counts(empty, path).count() == 0


def test_token_counts_resynchronise():
    import sentencepiece

    path, r = queries.tokenizer(queries.PIECES), random.Random(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["a", "é", " ", "  ", "\n", "the ", "ing", "😀", "　", "<s>", "1", "zzzz", "́", "ﬁ"]
    for n in (50, 400, 3000):
        for _ in range(15):
            t = "".join(r.choice(odd) for _ in range(n))
            assert tokens.PieceCounter(path, 30, 4).count(t) == len(sp.encode(t)), t


# ---- 2 ------------------------------------------------------------------------------------------------------------


def filled(sizes, weights, budget, most):
    left, todo, out = budget, dict(weights), {}
    while todo:
        level = left / sum(todo.values())
        full = [s for s in todo if most * sizes[s] < todo[s] * level]
        if not full:
            return out | {s: w * level for s, w in todo.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del todo[s]
    return out


def test_mixing(docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    of = {sizes[s]: want[s] for s in sizes}
    assert all(math.isclose(r["target"], of[r["source_size"]], rel_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[sizes[s]] - want[s]) <= 1 for s in sizes)
    assert bag(r.values() for r in rows) == got(mixing.mix(docs.repartition(7)))
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0


def test_repeat(docs):
    times = {r["doc_id"]: r["repeats"] + (r["extra"] > 0) for r in mixing.mix(docs.filter("doc_id <> 5")).collect()}
    have = Counter(r["doc_id"] for r in mixing.repeat(docs.filter("doc_id <> 5")).collect())
    assert {k: v for k, v in times.items() if v} == dict(have)


# ---- 3 ------------------------------------------------------------------------------------------------------------


def shingles(text):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set())


def brute_components(rows):
    """(id, n_shingles, component): by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def test_near_duplicates(docs, empty):
    want = brute_components([(i, t) for i, t, *_ in ROWS])
    have = minhash.near_duplicates(docs)
    assert got(have.select("doc_id", "n_shingles", "component_id")) == bag(want)
    assert have.filter("kept <> (doc_id <=> component_id)").count() == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_corpus(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    have = queries.op3_near_duplicates(spark, small)
    assert got(have.select("doc_id", "n_shingles", "component_id")) == bag(brute_components(rows))


def test_near_duplicates_chains(spark):
    """Long chains of close texts, and many near copies of one text."""
    r = random.Random(2)
    own = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(own)))
        own = own[4:] + [f"w{r.randrange(10**6)}" for _ in range(4)]
    center = [f"c{i}" for i in range(100)]
    for i in range(100, 220):
        x = list(center)
        x[r.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id")) == bag(brute_components(rows))


# ---- 4 ------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    page = "<html>" + "x" * 200 + "é</html>"
    rows = [(3, "u3", page), (1, "u1", page), (2, None, None), (4, "u\r\n4", page), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", "ok\r\n\r\nWARC/1.1\r\n" * 30), (None, "n", page), (8, "", "")]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "page_id long, url string, html string, id int, payload string").repartition(2)
    path = scratch(spark, "warc-test")
    warc.archive(df, path)
    back = warc.read_archive(spark, path)
    have = {(r["page_id"], r["record_type"]): r for r in back.collect()}
    assert len(have) == len(rows)
    assert have["1", "response"]["payload"].decode() == page and have["1", "response"]["target_uri"] == "u1"
    for k in ("3", "4"):
        r = have[k, "revisit"]
        assert r["refers_to"] == "<urn:page:1>" and r["payload_digest"] == hashlib.sha256(page.encode()).hexdigest() and r["payload_length"] == len(page.encode())
    assert have["4", "revisit"]["target_uri"] == "u\r\n4" and have["2", "response"]["target_uri"] is None
    assert have["7", "response"]["payload"].decode() == rows[6][2] and ("5", "response") in have and ("6", "response") in have
    assert back.filter("record_type = 'revisit' AND page_id IN ('3', '9')").select("page_id").collect()[0][0] == "3"
    assert warc.read_archive(spark, path, payloads=False).filter("payload is not null").count() == 0
    none = scratch(spark, "warc-none")
    warc.archive(df.limit(0), none)
    assert warc.read_archive(spark, none).count() == 0


def test_warc_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    first = {}
    for p in pages:
        h = p["html"] or ""
        if len(h.encode()) >= 100:
            first[h] = min(p["page_id"], first.get(h, p["page_id"]))
    want = []
    for p in pages:
        h = p["html"] or ""
        to = first.get(h, p["page_id"])
        want.append((p["page_id"], len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if to < p["page_id"] else "response", to if to < p["page_id"] else None))
    assert got(queries.op4_warc(spark, small)) == bag(want)


# ---- 5 ------------------------------------------------------------------------------------------------------------


def packing_holds(rows, texts, capacity):
    """rows: id, piece, start, length, ids, sequence, offset. The number of sequences."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer(queries.WORDS))
    own, places = {}, {}
    for i, piece, start, length, ids, sequence, offset in rows:
        assert len(ids) == length <= capacity and start == piece * capacity
        own.setdefault(i, []).append((start, ids))
        places.setdefault(sequence, []).append((offset, length))
    for i, t in texts.items():
        assert [x for _, ids in sorted(own[i]) for x in ids] == [*tk.encode(t or "", add_special_tokens=False).ids, 1], i
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, empty, capacity):
    path = queries.tokenizer(queries.WORDS)
    out = packing.pack(docs, path, capacity, with_ids=True).collect()
    unique = [tuple(r["doc_id" if k == "id" else k] for k in ("id", "piece", "start", "length", "ids", "sequence_id", "offset")) for r in out]
    once = {i: t for i, t, *_ in ROWS if i != 5}
    assert len([r for r in unique if r[0] == 5 and r[1] == 0]) == 3
    seen = Counter((r[5], r[6]) for r in unique)
    assert max(seen.values()) == 1
    total = sum(r[3] for r in unique)
    n = len({r[5] for r in unique})
    assert n <= 1.1 * total / capacity + 2
    packing_holds([r for r in packing_rows(docs.filter("doc_id <> 5 or doc_id is null"), path, capacity)], once, capacity)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    assert packing.pack(empty, path, capacity).count() == 0


def packing_rows(docs, path, capacity):
    return [tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")) for r in packing.pack(docs, path, capacity, with_ids=True).collect()]


def test_packing_is_tight(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing_rows(docs, queries.tokenizer(queries.WORDS), 4096)
    n = packing_holds(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 4096)
    assert n <= math.ceil(sum(r[3] for r in rows) / 4096) + 2


# ---- 6 ------------------------------------------------------------------------------------------------------------


def plain_base(text):
    """By the patterns as they are written."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_personal_data(spark, docs, empty, small):
    own = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for df in (docs, own):
        for r in df.select("doc_id", "text").join(pii.find_personal_data(df), "doc_id").collect():
            want = plain_base(r["text"] or "")
            assert pii.said([tuple(x) for x in r["base"]]) == want
            assert hashlib.sha256(want.encode()).hexdigest() == r["base_sha256"]
            assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
    assert pii.find_personal_data(docs).count() == len(ROWS) and pii.find_personal_data(empty).count() == 0


def test_personal_data_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("ab.@@-+ 1234567890()..%\n") for _ in range(r.randint(1, 60)))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(pii.base_spans(t), key=lambda x: (x[1], pii.TYPES.index(x[0])))) == plain_base(t), t


def test_personal_data_model():
    text = 'The api_key = "9fK2mQz7LxT4bV8nRw3sYc6D" of mr anna.lee@example.org and a well-known-word-2020 here'
    kinds = {k for k, _, _ in pii.spans_of(text)[1]}
    assert kinds == {"email", "secret"}
    assert pii.redacted(text) == 'The api_key = "[SECRET]" of mr [EMAIL] and a well-known-word-2020 here'
    m = pii.model()
    pinned = [pii.regions(pii.by_place(pii.base_spans(text)))]
    segments = pii.Segments([text], pinned)
    for _, _, chain in m.chains(segments, pinned, m.scores(segments)):
        marginals, _, _ = chain.expect()
        assert np.all(marginals >= -1e-9) and np.all(marginals.sum(axis=1) <= 1 + 1e-9)


def test_redact(docs):
    rows = {(r["doc_id"], r["lang"]): r["text"] for r in pii.redact(docs).collect()}
    assert rows[65, "en"] == "mail [EMAIL], [PHONE]; [IP]" and rows[60, None] is None


# ---- 7 ------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in out) / len(out)
    assert len(out) > 50 and right >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    labels = spark.createDataFrame([(i, 1 - (i in (69, 70)), "x") for i in range(71)] + [(None, 1, "x"), (3, None, "x"), (4, 1, "y")], "doc_id long, quality int, text string")
    model = gam.fit(docs, labels)
    have = gam.score(docs, model)
    assert have.count() == len(ROWS) and have.filter("score not between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert gam.score(empty, model).count() == 0 and gam.keep_good(docs, model).columns == docs.columns
    blank = gam.fit(docs, labels.limit(0))
    assert {tuple(r) for r in gam.score(docs, blank).select("score", "predicted").collect()} == {(0.5, 1)}
    shown = gam.fit(empty, labels)
    assert gam.score(docs, shown).count() == len(ROWS)


def test_quality_learns_interactions():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.train(x, y)
    assert ((m.logits(x) > 0) == (y > 0)).mean() > 0.95 and (0, 1) in m.pairs


# ---- 8 ------------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_host_rules(docs, empty):
    out = hosts.host_rules(docs)
    want = [(i, *plain_measures(t)) for i, t, *_ in ROWS]
    assert got(out.select("doc_id", *hosts.MEASURES)) == bag(want)
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert hosts.host_rules(empty).count() == 0


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i} nice" for i in range(60)), "#### " * 60 + " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "a") for i in range(40)] + [(100 + i, bad, "b") for i in range(40)] + [(200, good, "b"), (300, bad, None), (301, bad, "c"), (302, good, "c")]
    out = {r["doc_id"]: r["kept"] for r in hosts.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] and not out[200] and out[302] and not out[100]
    rates = {r["_host"]: r for r in hosts.host_rates(hosts.document_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert rates["a"]["shrunk_rate"] < 0.5 < rates["b"]["shrunk_rate"] and 0 < rates["a"]["shrunk_rate"] and rates["b"]["shrunk_rate"] < 1


def test_host_rules_corpus(spark, small):
    want = [(r["doc_id"], *plain_measures(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(queries.op8_host_rules(spark, small).select("doc_id", *hosts.MEASURES)) == bag(want)


# ---- 9 ------------------------------------------------------------------------------------------------------------


def plain_edited(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("per_bucket", [1, 5, 1000])
def test_fingerprints_of_edited(docs, empty, per_bucket):
    out = multiset.edited_fingerprints(docs, rows_per_bucket=per_bucket)
    assert got(out.select("doc_id", "n_chars", "edited_sha256")) == bag(plain_edited([(i, t) for i, t, *_ in ROWS]))
    assert out.filter("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    same = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
    assert same[63] == same[64] and same[60] == same[61] and len({same[i] for i in range(30)}) == 30
    assert same == {r["doc_id"]: r["fingerprint"] for r in multiset.fingerprints(docs).collect()}
    assert multiset.edited_fingerprints(empty).count() == 0


def test_fingerprints_corpus(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op9_fingerprints(spark, small)
    assert got(out.select("doc_id", "n_chars", "edited_sha256")) == bag(plain_edited(rows))
    r = out.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > r[1] + 0.2


def test_fingerprints_are_homomorphic():
    a, b, c = "first one. and more\nsecond", "third is here", "first one. and more\nthird is here\nsecond"
    va, vb, vc = multiset.vectors([a]), multiset.vectors([b]), multiset.vectors([c])
    assert (va + vb).hex() == vc.hex() and (vc - vb).hex() == va.hex()
    assert multiset.vectors(["x\ny"]).hex() == multiset.vectors(["y\nx"]).hex() != multiset.vectors(["x\ny\nx"]).hex()
    assert multiset.from_hex(vc.hex()).hex() == vc.hex()
    lines = [f"line {i} of text" for i in range(200)]
    one, two, other = multiset.vectors(["\n".join(lines)]), multiset.vectors(["\n".join(lines[:150] + [f"new {i}" for i in range(50)])]), multiset.vectors(["\n".join(f"z{i}" for i in range(200))])
    assert abs(multiset.likeness(one, two)[0] - 0.75) < 0.12 and multiset.likeness(one, other)[0] < 0.3 and multiset.likeness(one, one)[0] == 1


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    out = queries.op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in own) / len(own) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    model = langid.fit(docs)
    have = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert have[60]["lang_pred"] == have[61]["lang_pred"] == "und" and have[62]["lang_pred"] == "und" and have[1]["lang_pred"] in ("en", "de")
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_forward_backward():
    r = np.random.default_rng(2)
    t = r.random((3, 3)).astype(np.float32) + 0.1
    sizes = [0, 1, 5, langid.CHUNK, langid.CHUNK + 1, 3 * langid.CHUNK + 7, 0, 2]
    docs = np.concatenate([[0], np.cumsum(sizes)])
    p = (r.random((docs[-1], 3)) + 0.01).astype(np.float32)
    have = langid.forward_backward(p, docs, t)
    for a, b in zip(docs[:-1], docs[1:], strict=True):
        f, v = [], np.full(3, 1 / 3)
        for x in p[a:b]:
            v = (v @ t) * x
            v = v / v.sum()
            f.append(v)
        back = np.ones(3)
        for i in reversed(range(b - a)):
            m = f[i] * back
            assert np.allclose(have[a + i], m / m.sum(), atol=1e-4)
            back = t @ (p[a + i] * back)
            back = back / back.sum()


def test_language_of_switched_text(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    names, share = model.predict(pa.array(["Ertheding thhaou the and of thation ingnd", "die der und enkeit schau verein einung lich", None, "123 !?"]))
    assert names == ["en", "de", "und", "und"] and share[2] == share[3] == 0 and model.transitions.trace() > 0


def test_words():
    text = pa.array(["a b\tc", None, "", "  é x y "])
    w = words.batch_words(text)
    assert [w.values[int(c)].as_py().decode() for c in w.codes] == ["a", "b", "c", "é", "x y"] and w.docs.tolist() == [0, 3, 3, 3, 5]
