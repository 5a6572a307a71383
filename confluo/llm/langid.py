"""Language of texts by a linear-chain conditional random field over words.

Each word has a score for each language: affixes, byte n-grams and membership in learned lexicons, as weights. Learned
transitions tie neighbouring words together, so words of code-switched text are labelled jointly by forward-backward.
A text's language is the one with the most expected words.

The recursion is exact and works on many texts at once: words are dealt into chunks, the product of each chunk's steps
is taken from every starting label, the products are chained along each text, and then every chunk runs forward and
backward from what enters it on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, columns, remainder_of_id
from .words import batch_words, mix64, text_bytes

BUCKETS = 1 << 16
CHUNK = 64
#: Characters that are no part of a word proper.
EDGES = ".,;:!?|\"'()[]{}<>#*$%&+-=_/\\@^~`0123456789«»“”„…¡¿"
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(remainder_of_id(id_col, 5) == 0, F.lit(False))


def normal_words(values: pa.Array) -> pa.Array:
    """Words in lower case, without punctuation at their ends."""
    return pc.utf8_trim(pc.utf8_lower(values.cast(pa.string())), EDGES)


def gram_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of each word, and n + 1 places where each word's begin: byte n-grams of 2 to 4 within ^word$,
    and affixes of 1 to 3 bytes, told apart from grams inside."""
    data, offsets = text_bytes(words)
    n = len(words)
    lengths = np.diff(offsets) + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(at[-1] + 4, np.uint64)
    word_of = np.repeat(np.arange(n), lengths)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    flat[: at[-1]][inner] = data
    flat[at[:-1]], flat[at[1:] - 1] = 1, 2
    left = at[1:][word_of] - np.arange(at[-1])  # bytes from here to the word's end
    found, owners = [], []
    code = flat[: at[-1]].copy()
    for k in (2, 3, 4):
        code = code * np.uint64(257) + flat[k - 1 : at[-1] + k - 1]
        ok = left >= k
        found.append(mix64(code[ok] + np.uint64(k << 56)) % np.uint64(BUCKETS))
        owners.append(word_of[ok])
    for k in (1, 2, 3):
        ok = np.flatnonzero(lengths - 2 >= k)
        for side, base in ((1, at[:-1] + 1), (2, at[1:] - 1 - k)):
            c = np.full(len(ok), k, np.uint64)
            for i in range(k):
                c = c * np.uint64(257) + flat[base[ok] + i]
            found.append(mix64(c + np.uint64(side << 60)) % np.uint64(BUCKETS))
            owners.append(ok)
    owner, bucket = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


@dataclass
class Model:
    labels: list[str]
    lexicon: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    lexicon_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: of each lexicon word, its label
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    lexicon_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def emissions(self, words: pa.Array) -> np.ndarray:
        """(words, labels): the score of each word."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 20_000):  # a bounded number of words at a time
            own = words[a : a + 20_000]
            bucket, places = gram_features(own)
            some = np.flatnonzero(np.diff(places))
            if len(some):
                out[a + some] = np.add.reduceat(self.weights[bucket], places[some], axis=0)
        known = pc.index_in(words, self.lexicon).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(known >= 0)
        out[hit] += self.lexicon_weights[self.lexicon_of[known[hit]]]
        return out

    def expected(self, scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """(texts, labels): the expected number of words of each label. scores: of each word; docs: n + 1 places."""
        marginals = forward_backward(np.exp(scores - scores.max(axis=1, keepdims=True)), docs, np.exp(self.transitions).astype(np.float32))
        out = np.zeros((len(docs) - 1, len(self.labels)))
        some = np.flatnonzero(np.diff(docs))
        if len(some):
            out[some] = np.add.reduceat(marginals.astype(float), docs[some], axis=0)
        return out

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        text = text.cast(pa.string())
        letters = pc.match_substring_regex(pc.fill_null(text, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.labels:
            return [UNKNOWN] * len(text), np.zeros(len(text))
        w = batch_words(text)
        values = normal_words(w.values)
        full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
        kept = full[w.codes] if len(w.codes) else np.zeros(0, bool)
        docs = np.concatenate([[0], np.cumsum(kept)])[w.docs]
        mass = self.expected(self.emissions(values)[w.codes[kept]], docs) if kept.any() else np.zeros((len(text), len(self.labels)))
        mass += 1e-9
        best = mass.argmax(axis=1)
        share = mass[np.arange(len(mass)), best] / mass.sum(axis=1)
        return [self.labels[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)], np.where(letters, share, 0.0)


def forward_backward(p: np.ndarray, docs: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Marginals of each word's label. p: (words, labels) potentials; docs: n + 1 places of texts; t: (labels, labels) steps.

    Before the first word every label is as likely. All products are rescaled at each step.
    """
    n_words, k = p.shape
    per = -(-np.diff(docs) // CHUNK)
    first = np.cumsum(per) - per
    n = int(per.sum())
    nth = np.arange(n) - np.repeat(first, per)
    starts = np.repeat(docs[:-1], per) + nth * CHUNK
    size = np.minimum(CHUNK, np.repeat(docs[1:], per) - starts)
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    active = [int(np.searchsorted(-size, -i, side="left")) for i in range(CHUNK)]  # chunks with more than i words
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head, tail = np.full((n, k), 1 / k, np.float32), np.ones((n, k), np.float32)
    if (per > 1).any():
        whole = np.tile(np.eye(k, dtype=np.float32), (n, 1, 1))
        for i, m in enumerate(active):
            step = (whole[:m].reshape(-1, k) @ t).reshape(m, k, k) * p[starts[:m] + i][:, None, :]
            whole[:m] = step / step.max(axis=(1, 2), keepdims=True)
        many = np.flatnonzero(per > 1)
        many = many[np.argsort(-per[many], kind="stable")]
        for i in range(1, int(per.max())):
            own = many[: np.searchsorted(-per[many], -i, side="left")]
            v = np.einsum("nk,nkl->nl", head[place[first[own] + i - 1]], whole[place[first[own] + i - 1]])
            head[place[first[own] + i]] = v / v.sum(axis=1, keepdims=True)
        for i in range(1, int(per.max())):
            own = many[: np.searchsorted(-per[many], -i, side="left")]
            last = first[own] + per[own] - i
            v = np.einsum("nkl,nl->nk", whole[place[last]], tail[place[last]])
            tail[place[last - 1]] = v / v.max(axis=1, keepdims=True)
    forward = np.zeros((CHUNK, n, k), np.float32)
    for i, m in enumerate(active):
        step = (head[:m] @ t) * p[starts[:m] + i]
        head[:m] = forward[i, :m] = step / step.sum(axis=1, keepdims=True)
    out = np.zeros((n_words, k), np.float32)
    for i in reversed(range(CHUNK)):
        m = active[i]
        both = forward[i, :m] * tail[:m]
        out[starts[:m] + i] = both / both.sum(axis=1, keepdims=True)
        back = (tail[:m] * p[starts[:m] + i]) @ t.T
        tail[:m] = back / back.max(axis=1, keepdims=True)
    return out


# ---- learning -----------------------------------------------------------------------------------------------------


@dataclass
class Sample:
    """Words of whole texts as codes: one array for all texts, n + 1 places where each text's words start, and labels."""

    codes: np.ndarray
    values: pa.Array  #: the word of each code
    docs: np.ndarray
    labels: list[str]

    @classmethod
    def of(cls, text: pa.Array, labels: list[str]) -> Sample:
        w = batch_words(text)
        values = normal_words(w.values).dictionary_encode()  # words that differ in case or edges alone become one
        codes = values.indices.to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, np.int32)
        full = (pc.binary_length(values.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
        docs = np.concatenate([[0], np.cumsum(full)])[w.docs]
        some = np.flatnonzero(np.diff(docs))
        return cls(codes[full], values.dictionary, np.append(docs[some], len(codes[full])), [labels[i] for i in some])


def sequences(s: Sample, labels: np.ndarray, n_labels: int, rng: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """n sequences of `length` words: spans of documents, half of the sequences switching between languages."""
    by = [np.flatnonzero(labels == i) for i in range(n_labels)]
    size = np.diff(s.docs)
    out, gold = [], []
    for _ in range(n):
        have = 0
        switch, lab = rng.random() < 0.5, int(rng.integers(n_labels))
        while have < length:
            doc = int(rng.choice(by[lab]))
            want = min(length - have, int(rng.integers(4, 25)) if switch else length, int(size[doc]))
            a = int(s.docs[doc]) + int(rng.integers(int(size[doc]) - want + 1))
            out.append(s.codes[a : a + want])
            gold += [lab] * want
            have += want
            if switch:
                lab = int(rng.integers(n_labels))
    return np.concatenate(out), np.array(gold)


def train(sample: Sample, seed: int = 7, batches: int = 160, n: int = 48, length: int = 40, rate: float = 0.25, decay: float = 1e-5) -> Model:
    """Gradient ascent (adaptive steps) on the log-likelihood of spans, of which half switch between languages."""
    names = sorted(set(sample.labels))
    m = Model(names)
    k = len(names)
    m.weights, m.lexicon_weights, m.transitions = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k))
    if not k:
        return m
    of = np.array([names.index(x) for x in sample.labels])
    n_values = len(sample.values)
    seen = np.stack([np.bincount(sample.codes[np.repeat(of == i, np.diff(sample.docs))], minlength=n_values) for i in range(k)], axis=1)
    total = seen.sum(axis=1)
    known = np.flatnonzero((total >= 5) & (seen.max(axis=1) >= 0.6 * total))
    words = sample.values.take(pa.array(known))
    order = pc.sort_indices(words).to_numpy(zero_copy_only=False)
    m.lexicon, m.lexicon_of = words.take(pa.array(order)), seen[known].argmax(axis=1)[order].astype(np.int64)
    rng = np.random.default_rng(seed)
    squares = [np.full_like(x, 1e-6) for x in (m.weights, m.lexicon_weights, m.transitions)]
    docs = np.arange(0, n * length + 1, length)
    for _ in range(batches):
        flat, gold = sequences(sample, of, k, rng, n, length)
        used, codes = np.unique(flat, return_inverse=True)
        own = sample.values.take(pa.array(used))
        scores = m.emissions(own)[codes]
        p, t = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(m.transitions).astype(np.float32)
        marginals = forward_backward(p, docs, t)
        slope = np.eye(k)[gold] - marginals
        by_word = np.column_stack([np.bincount(codes, slope[:, i], len(own)) for i in range(k)])
        bucket, places = gram_features(own)
        spread = np.repeat(by_word, np.diff(places), axis=0)
        found = pc.index_in(own, m.lexicon).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(found >= 0)
        lex = np.zeros((k, k))
        np.add.at(lex, m.lexicon_of[found[hit]], by_word[hit])
        pairs = pair_slope(p.reshape(n, length, k), gold.reshape(n, length), t)
        steps = [np.column_stack([np.bincount(bucket, spread[:, i], BUCKETS) for i in range(k)]), lex, pairs]
        for x, g, s in zip((m.weights, m.lexicon_weights, m.transitions), steps, squares, strict=True):
            g = g / n
            s += g**2
            x += rate * g / np.sqrt(s) - decay * x
    return m


def pair_slope(p: np.ndarray, gold: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Observed minus expected numbers of neighbouring labels."""
    n, length, k = p.shape
    fwd = np.zeros_like(p)
    v = np.full((n, k), 1 / k, np.float32)
    for i in range(length):
        v = (v @ t) * p[:, i]
        v /= v.sum(axis=1, keepdims=True)
        fwd[:, i] = v
    out, back = np.zeros((k, k)), np.ones((n, k), np.float32)
    for i in reversed(range(1, length)):
        right = p[:, i] * back
        both = fwd[:, i - 1][:, :, None] * t[None] * right[:, None, :]
        out -= (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        np.add.at(out, (gold[:, i - 1], gold[:, i]), 1)
        back = right @ t.T
        back /= back.max(axis=1, keepdims=True)
    return out


def sampled(docs: DataFrame, per_language: int, most_bytes: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, text, lang: of each language the first `per_language` different rows by hash of id and text, as far as their texts
    together have `most_bytes` bytes at most. Copies of a row count once. Rows are picked by numbers alone; texts are read for
    those that were picked."""
    own = columns(docs, [id_col, text_col, lang_col]).toDF("id", "text", "lang").filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    own = own.withColumn("h", F.xxhash64("id", "text"))
    keys = own.groupBy("lang", "h").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")).filter(F.col("bytes") <= most_bytes)
    # The hashes are uniform: ranges of them are counted, and only those that hold the first rows of a language go on to be ranked.
    span = F.shiftright("h", 48)
    counts = keys.groupBy("lang", span.alias("span")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("span")) - F.col("n")
    spans = counts.withColumn("before", before).filter(F.col("before") < per_language).select("lang", "span")
    keys = keys.withColumn("span", span).join(F.broadcast(spans), ["lang", "span"], "left_semi")  # per_language spans a language at most
    first = Window.partitionBy("lang").orderBy("h")
    keys = keys.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language)
    keys = keys.withColumn("total", F.sum("bytes").over(first)).filter(F.col("total") <= most_bytes).select("lang", "h")
    picked = own.join(F.broadcast(keys), ["lang", "h"])  # per_language rows a language at most
    return picked.groupBy("lang", "h").agg(F.any_value("id").alias("id"), F.any_value("text").alias("text")).select("id", "text", "lang")


def fit(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = 16 << 20) -> Model:
    """Learn from rows that are not held out and have a language and an id: of each language `per_language` different rows at
    most, picked by hash of the id and text, each with its whole text, and `most_bytes` (16 MB) of text at most. So the driver
    holds a bounded sample of each language, however many copies a row has and however long texts are. Other columns are
    ignored, whatever their names. Without such rows the model knows no language."""
    got = sampled(docs, per_language, most_bytes, id_col, text_col, lang_col).toArrow().sort_by([("id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    if not len(got):
        return Model([])
    return train(Sample.of(got.column("text"), got.column("lang").to_pylist()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (the share of words expected in that language).

    Texts that are null or have no letter are `und` with score 0, as are all where no language was learned. Of languages
    with equally many expected words the first by name is taken. Repeated
    rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    own = columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            names, share = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share)], [id_col, "lang_pred", "score"])

    return own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, lang_pred string, score double")
