"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. So equal multisets of paragraphs have equal fingerprints in any order, and a
paragraph is inserted or deleted by adding or subtracting its vector. A vector has three parts: EXACT lanes modulo 2^64
that tell texts apart, a count of units modulo 2^32, and SKETCH lanes modulo 2^16 to which each unit of the paragraph
(a sentence; long ones are cut after words picked by their content) adds +1 or -1. The mean square of the difference
of two sketches estimates how many units two documents do not share, and from that, against what each has, their likeness.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .shared import bounded, columns

EXACT, SKETCH = 8, 128
WIDTH = 8 * EXACT + 4 + 2 * SKETCH  # bytes of a fingerprint

#: A unit ends after the marks of a sentence, and in a long sentence after a word whose last two letters are of this small set.
UNIT = re.compile(rb"[^.!?]*?(?:[.!?]+(?:\s|$)|[aeiou][nrst]\s|$)|[^.!?]+|[.!?]+", re.S)


def units(paragraph: bytes) -> list[bytes]:
    return [x for x in UNIT.findall(paragraph) if x.strip()] or [paragraph]


class Vectors:
    """The vectors of texts, as arrays: exact (n, 8) uint64, count (n) uint32, sketch (n, 128) uint16."""

    def __init__(self, exact: np.ndarray, count: np.ndarray, sketch: np.ndarray):
        self.exact, self.count, self.sketch = exact, count, sketch

    def __add__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact + other.exact, self.count + other.count, self.sketch + other.sketch)

    def __sub__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact - other.exact, self.count - other.count, self.sketch - other.sketch)

    def __getitem__(self, rows) -> Vectors:
        return Vectors(self.exact[rows], self.count[rows], self.sketch[rows])

    def __len__(self) -> int:
        return len(self.count)

    def hex(self) -> list[str]:
        parts = [self.exact.astype("<u8").view(np.uint8).reshape(len(self), -1), self.count.astype("<u4").view(np.uint8).reshape(len(self), -1), self.sketch.astype("<u2").view(np.uint8).reshape(len(self), -1)]
        flat = np.ascontiguousarray(np.hstack(parts)).tobytes().hex()
        return [flat[i : i + 2 * WIDTH] for i in range(0, len(flat), 2 * WIDTH)]


def from_hex(prints: list[str]) -> Vectors:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), WIDTH)
    cut = lambda a, b, kind: np.ascontiguousarray(raw[:, a:b]).view(kind)
    return Vectors(cut(0, 8 * EXACT, "<u8"), cut(8 * EXACT, 8 * EXACT + 4, "<u4").ravel(), cut(8 * EXACT + 4, WIDTH, "<u2"))


def vectors(texts: list[str]) -> Vectors:
    """Fingerprints of whole texts. An empty text has no paragraph: zeros."""
    wide, bits, n_units, n_paragraphs = [], [], [], []
    for text in texts:
        paragraphs = text.encode().split(b"\n") if text else []
        n_paragraphs.append(len(paragraphs))
        wide += [hashlib.blake2b(p).digest() for p in paragraphs]
        own = [u for p in paragraphs for u in units(p)]
        n_units.append(len(own))
        bits += [xxhash.xxh3_128_digest(u) for u in own]
    n = len(texts)
    exact, sketch = np.zeros((n, EXACT), np.uint64), np.zeros((n, SKETCH), np.uint16)
    counts = np.array(n_units, np.int64)
    if wide:
        some = np.flatnonzero(n_paragraphs)
        starts = (np.cumsum(n_paragraphs) - n_paragraphs)[some]
        exact[some] = np.add.reduceat(np.frombuffer(b"".join(wide), "<u8").reshape(-1, EXACT), starts, axis=0)
        raw = np.frombuffer(b"".join(bits), np.uint8).reshape(-1, SKETCH // 8)
        step = 1 << 15
        docs = np.repeat(np.arange(n), counts)
        for a in range(0, len(raw), step):  # a bounded number of units at a time
            own = docs[a : a + step]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            ones = np.add.reduceat(np.unpackbits(raw[a : a + step], axis=1), heads, axis=0, dtype=np.int32)
            each = np.diff(np.append(heads, len(own)))[:, None]
            sketch[own[heads]] += (2 * ones - each).astype(np.int64).astype(np.uint16)
    return Vectors(exact, counts.astype(np.uint32), sketch)


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """0 to 1: 1 for equal fingerprints, else 1 - (units not shared) / (units of both), as estimated from the sketches.

    The mean square of a sketch estimates the sum of squares of how often each unit comes, which is the number of units where
    all differ. Where units repeat (a line said over and over) it is more, above and below the line alike."""
    size = lambda x: (x.astype(np.int16).astype(float) ** 2).mean(axis=1)
    total = np.maximum(a.count.astype(float) + b.count.astype(float), size(a.sketch) + size(b.sketch))
    out = np.clip(1 - size(a.sketch - b.sketch) / np.maximum(total, 1), 0, 1)
    same = (a.exact == b.exact).all(axis=1) & (a.count == b.count) & (a.sketch == b.sketch).all(axis=1)
    return np.where(same, 1.0, np.minimum(out, 1 - 1e-9))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (hex). Null text: as empty. Repeated rows and null ids are kept; other columns are ignored."""
    own = columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors(pc.fill_null(b.column(1).cast(pa.string()), "").to_pylist()).hex())], [id_col, "fingerprint"])

    return own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, fingerprint string")


# ---- each text against the next -----------------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """`text` with its last half (rounded down) of code points replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def descending(value):
    """A value that sorts ascending as `value` sorts descending: numbers and dates negated, texts by code points."""
    if isinstance(value, str):
        return (*[-ord(c) for c in value], 1)
    return -value if isinstance(value, (int, float)) else -value.toordinal() if hasattr(value, "toordinal") and not hasattr(value, "hour") else -value.timestamp()


@dataclass
class Cuts:
    """Where the order of rows (falling id, null last; text) is cut: sorted keys of id, start of the text and a number in
    [0, 1). Texts count only for ids that many rows share, numbers only for those of them whose texts are all the same."""

    keys: list[tuple] = field(default_factory=list)
    ids: np.ndarray | None = None  #: the ids of the keys, rising, where they alone decide and are numbers
    hot: frozenset = frozenset()
    same: frozenset = frozenset()

    def key(self, value, start: str = "", number: float = 0.0) -> tuple:
        crowded = value in self.hot
        return (value is None, 0 if value is None else descending(value), start if crowded else "", number if crowded and (value, start) in self.same else 0.0)

    def buckets(self, ids: pd.Series, starts: pd.Series, numbers: pd.Series) -> np.ndarray:
        if self.ids is None:
            return np.array([bisect.bisect_right(self.keys, self.key(None if pd.isna(i) else i, s, x)) for i, s, x in zip(ids.tolist(), starts, numbers, strict=True)], np.int32)
        out = np.full(len(ids), len(self.keys), np.int32)
        there = ids.notna().to_numpy()
        out[there] = len(self.ids) - np.searchsorted(self.ids, ids[there].astype(self.ids.dtype).to_numpy(), side="left")
        return out


def find_cuts(rows: DataFrame, n: int, n_buckets: int, start_chars: int = 64, hits: int = 40) -> Cuts:
    """Cuts by a sample of about 20 rows a bucket. Ids with `hits` of them are cut by the starts of their texts, and starts with
    as many, if they are all of one text, into equal parts. rows: id, text."""
    if n_buckets <= 1:
        return Cuts(ids=np.zeros(0, np.int64))
    share = min(1.0, 20 * n_buckets / n)
    ids = [r[0] for r in rows.select("id").filter(F.rand(5) < share).collect()]
    out = Cuts(hot=frozenset(i for i, k in Counter(ids).items() if k >= hits))
    keys = [out.key(i) for i in ids if i not in out.hot]
    if out.hot:
        session, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        crowded = F.broadcast(session.createDataFrame([(i,) for i in out.hot], f"hot {kind}"))
        own = rows.withColumn("start", F.coalesce(F.substring("text", 1, start_chars), F.lit(""))).join(crowded, F.col("id").eqNullSafe(F.col("hot")), "left_semi")
        found = Counter((r[0], r[1]) for r in own.filter(F.rand(6) < share).select("id", "start").collect())
        often = [k for k, c in found.items() if c >= hits]
        if often:
            groups = F.broadcast(session.createDataFrame(often, f"hot {kind}, often string"))
            texts = own.join(groups, F.col("id").eqNullSafe(F.col("hot")) & (F.col("start") == F.col("often"))).groupBy("hot", "often").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
            out.same = frozenset((r[0], r[1]) for r in texts.filter("a = b").collect())
        keys += [out.key(i, s, k / c) for (i, s), c in found.items() for k in range(c)]
    keys.sort()
    out.keys = sorted(set(keys[:: max(1, len(keys) // n_buckets)]))
    if not out.hot and not isinstance(ids[0] if ids else 0, str) and all(isinstance(i, int) for i in ids if i is not None):
        out.ids = np.array(sorted(-k[1] for k in out.keys if not k[0]), np.int64)
        out.keys = [k for k in out.keys if not k[0]]
    return out


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_bucket: int) -> DataFrame:
    """(bucket, extra, id, text): the rows by falling id (and text) in buckets, each followed by `extra` rows that open the next
    bucket (the last by those that open the first). The order is cut by a sample, so what the driver holds, about 20 ids
    for each bucket (100,000 buckets at most), follows the number of buckets. Ids that many rows share, or many rows
    without one, are cut by their texts, and copies of one text into equal parts."""
    own = columns(docs, [id_col, text_col]).toDF("id", "text")
    n = own.select("id").count()
    cuts = own.sparkSession.sparkContext.broadcast(find_cuts(own, n, max(1, min(100_000, n // rows_per_bucket))))

    @F.pandas_udf(IntegerType())
    def bucket_of(ids: pd.Series, starts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series(cuts.value.buckets(ids, starts, numbers))

    start = F.coalesce(F.substring("text", 1, 64), F.lit("")) if cuts.value.hot else F.lit("")
    placed = own.withColumn("bucket", bucket_of("id", start, F.rand(7) if cuts.value.same else F.lit(0.0)))
    opens = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max("id").alias("id")).collect())
    before = {b: opens[i - 1][0] for i, (b, _) in enumerate(opens)}  # the first opens after the last
    first = own.sparkSession.createDataFrame([(b, i, before[b]) for b, i in opens], f"bucket int, head {own.schema['id'].dataType.simpleString()}, before int")
    marked = placed.join(F.broadcast(first), "bucket")
    here = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    copies = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(here, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(here))
    return marked.withColumn("c", F.explode(copies)).select("c.bucket", "c.extra", "id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 1000) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the start of the next document's, by falling id; the last is followed
    by the first, and a lone document by itself. Rows that share an id follow one another by text, the shorter code
    points first; null ids come last. Null text: as empty. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Only one row is held back at a time, so no bucket is gathered in memory. Buckets hold
    about `rows_per_bucket` rows also where many rows share an id, have none, or are copies.
    """
    rows = with_next(docs, id_col, text_col, rows_per_bucket)
    id_type = rows.schema["id"].dataType.simpleString()
    parts = rows.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: bucket, extra, id, text, vectors
        for b in bounded(batches):
            bucket, extra, ids = (b.column(i).to_pylist() for i in range(3))
            texts = pc.fill_null(b.column(3).cast(pa.string()), "").to_pylist()
            own = vectors(texts)
            if held is not None:
                bucket, extra, ids, texts = [held[0], *bucket], [held[1], *extra], [held[2], *ids], [held[3], *texts]
                own = Vectors(*[np.concatenate([getattr(held[4], k), getattr(own, k)]) for k in ("exact", "count", "sketch")])
            at = [i for i in range(len(ids) - 1) if not extra[i] and bucket[i + 1] == bucket[i]]
            if at:
                new = [edited(texts[i], texts[i + 1]) for i in at]
                changed, mine, following = vectors(new), own[at], own[[i + 1 for i in at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], b.schema.field(2).type), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                        pa.array(mine.hex()), pa.array(changed.hex()), pa.array(likeness(mine, changed)), pa.array(likeness(mine, following)),
                    ],
                    [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            held = (bucket[-1], extra[-1], ids[-1], texts[-1], own[[len(ids) - 1]]) if ids else held

    return parts.mapInArrow(run, f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
