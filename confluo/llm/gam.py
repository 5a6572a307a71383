"""Quality scores by a generalised additive model with pairwise interactions.

Each text becomes a few numbers (shape, repetition, symbols, case). Every number has a lookup table over its bins,
learned by cyclic boosting: the features take turns, and at each turn a shallow tree of a few cuts, fitted to what is
still unexplained, is added to that feature's table. The pairs of features that explain most of the rest then get
tables of two dimensions in the same way. A score is the sum of looked-up values, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, columns, hinted, remainder_of_id
from .words import SPACE, batch_words

FEATURES = (
    "log_words", "word_bytes", "word_bytes_spread", "longest_word", "symbols", "punctuation", "exclamations", "upper", "digits", "wordless",
    "distinct_words", "commonest_word", "same_as_before", "repeated_lines", "lines", "sentence_ends", "letters_ascii",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 6


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS = _table(b"#*$%&|<>=@^_~{}[]\\/")
PUNCTUATION = _table(b"!\"'(),-.:;?")
UPPER, LOWER, DIGITS = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(remainder_of_id(id_col, 3) == 1, F.lit(False))


def spans_sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of `mask` hold between each offset and the next."""
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def code_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, the number of its group (by first appearance); the size of each group."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes, np.bincount(codes)


def line_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line (split at line feeds): its text's number, a code of its content, whether it has a word."""
    n = len(offsets) - 1
    feed = data == 10
    per = spans_sum(feed, offsets) + 1
    doc = np.repeat(np.arange(n), per)
    feeds = np.flatnonzero(feed)
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")  # each line's end, a feed or the text's end
    starts = np.empty(len(ends), np.int64)
    first = np.cumsum(per) - per
    starts[1:] = ends[:-1] + 1
    starts[first] = offsets[:-1]
    solid = data[~feed]
    removed = np.concatenate([[0], np.cumsum(feed, dtype=np.int64)])
    at = np.append(starts - removed[starts], len(solid)).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(solid))])
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
    inside = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
    return doc, codes, inside[ends] > inside[starts]


def text_features(text: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text. Null and empty texts: zeros."""
    w = batch_words(text)
    data, offsets, n_docs = w.data, w.offsets, len(w.offsets) - 1
    n_words, n_bytes = np.diff(w.docs), np.diff(offsets)
    words, size = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    doc = w.doc_of()
    lengths = w.lengths.astype(np.int64)
    total, squares = np.bincount(doc, lengths, n_docs), np.bincount(doc, lengths.astype(float) ** 2, n_docs)
    mean = total / words
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc, lengths)
    letters = LOWER[data] | UPPER[data] | (data >= 128)
    n_upper, n_lower = spans_sum(UPPER[data], offsets), spans_sum(LOWER[data], offsets)
    first = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    has_letter = first[w.starts + lengths] > first[w.starts]
    groups, sizes = code_groups(doc * np.int64(max(1, len(w.values))) + w.codes)
    group_doc = np.zeros(len(sizes), np.int64)
    group_doc[groups] = doc
    commonest = np.zeros(n_docs)
    np.maximum.at(commonest, group_doc, sizes)
    same = np.zeros(len(doc), bool)
    same[1:] = (w.codes[1:] == w.codes[:-1]) & (doc[1:] == doc[:-1])
    line_doc, codes, worded = line_codes(data, offsets)
    line_doc, codes = line_doc[worded], codes[worded]
    n_lines = np.bincount(line_doc, minlength=n_docs)
    line_group, line_sizes = code_groups(line_doc * np.int64(int(codes.max(initial=0)) + 1) + codes)
    of = np.zeros(len(line_sizes), np.int64)
    of[line_group] = line_doc
    kinds = np.bincount(of, minlength=n_docs)
    last = data[w.starts + lengths - 1] if len(doc) else np.zeros(0, np.uint8)
    share = lambda mask: spans_sum(mask, offsets) / size
    by_word = lambda mask: np.bincount(doc, mask, n_docs) / words
    out = [
        np.log1p(n_words), mean, np.sqrt(np.maximum(0, squares / words - mean**2)), np.log1p(longest), share(SYMBOLS[data]), share(PUNCTUATION[data]), share(data == 33), n_upper / np.maximum(1, n_upper + n_lower), share(DIGITS[data]), by_word(~has_letter),
        np.bincount(group_doc, minlength=n_docs) / words, commonest / words, by_word(same), (n_lines - kinds) / np.maximum(1, n_lines), n_lines / words, by_word(last == 46), (n_upper + n_lower) / size,
    ]
    return np.column_stack(out)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  #: of each feature, the rising cuts between its bins
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for i, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, i], side="right")]
        if self.pairs:
            coarse = {i: np.searchsorted(self.pair_edges[i], x[:, i], side="right") for i in {i for p in self.pairs for i in p}}
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[coarse[i], coarse[j]]
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(text_features(text)), -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Where to cut a row of bins so that two values explain most; the gain and the first bin on the right."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 4) -> np.ndarray:
    """A value for each bin, by a tree of so many leaves at most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*best_cut(g[a:b], h[a:b], penalty), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(found)
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def square_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts the one feature, then each side by the other; its gain and its table."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(gg)):
            gain, out = 0.0, np.zeros_like(gg)
            for part in (slice(0, at), slice(at, None)):
                a, b = gg[part].sum(axis=0), hh[part].sum(axis=0)
                row = shallow_tree(a, b, penalty, leaves=2)
                gain += float(2 * (row * a).sum() - (row**2 * (b + penalty)).sum())
                out[part] = row
            if gain > best[0]:
                best = (gain, out.T if turn else out)
    return best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 12, rate: float = 0.15, penalty: float = 4.0) -> Model:
    """Fit the tables to rows of features and labels 0 or 1. Without rows of both kinds, the base rate alone."""
    m = Model()
    if not len(y):
        return m
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return m
    m.edges = [cuts(x[:, i], BINS) for i in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(m.edges)]
    logit = np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, b in enumerate(bins):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b, g, len(m.tables[i])), np.bincount(b, h, len(m.tables[i])), penalty)
            m.tables[i] += step
            logit += step[b]
    m.pair_edges = [cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    coarse, n = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(m.pair_edges)], PAIR_BINS

    def square(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        key = coarse[i] * n + coarse[j]
        return square_tree(np.bincount(key, g, n * n).reshape(n, n), np.bincount(key, h, n * n).reshape(n, n), penalty)

    ranked = sorted(((square(i, j)[0], -i, -j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    m.pairs = [(-i, -j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((n, n)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(m.pairs):
            step = rate * square(i, j)[1]
            m.pair_tables[k] += step
            logit += step[coarse[i], coarse[j]]
    return m


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows that are not held out, or a sample of them by hash of about `max_rows`, the bound on what
    the driver holds. Rows without an id or label teach nothing; of documents that share an id, one teaches; repeated
    labels of an id count by their mean. Other columns are ignored, whatever their names."""
    known = columns(labels, [id_col, label_col]).toDF("id", "label").filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * max_rows // n)
    sample = columns(docs, [id_col, text_col]).toDF("id", "text").join(hinted(known, min(n, max_rows)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            x = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, x array<double>").groupBy("id").agg(F.max(F.struct("x", "label")).alias("r"))
    got = rows.select("id", "r.label", "r.x").toArrow().sort_by("id")
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return train(x, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 if score >= 0.5, else 0). A null or empty text gets the score of zeros.
    Repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored."""
    own = columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            s = model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that the model does not reject: those of a score of 0.5 or more. Null and empty
    texts are judged by the score of zeros; repeated rows are kept or go alike; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield b.filter(pa.array(model.scores(b.column(b.schema.get_field_index(text_col))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
