"""Best-fit packing by length patterns and non-negative least squares.

The lengths of all pieces form a histogram (at most `capacity` entries, whatever the number of documents). Patterns of
one to three coarse lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down. Each pattern is then dealt exact lengths, the last by best fit, and what
is left is packed best-fit decreasing, into gaps first. All of that works on counts. Pieces meet their places by their
rank among pieces of the same length, in a join-free lookup.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, columns, stash

SALTS = 1024  # each length is ranked in so many parts

#: How the tokenizer that units are sound for normalises texts, splits them, and marks the ends of words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


# ---- token ids ----------------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Of each Latin-1 character: 0 white space, 1 letter, 2 number, 3 else."""
    import regex

    kinds = ((r"\s", 0), (r"\p{L}", 1), (r"\p{N}", 2))
    return np.array([next((k for p, k in kinds if regex.fullmatch(p, chr(i))), 3) for i in range(256)], np.uint8)


class WordEncoder:
    """Token ids by the tokenizers library, where units that stand between white space or change of character class are
    encoded once and remembered.

    Sound for a tokenizer that drops white space and splits words by character class (letters, single numbers, the rest),
    as NORMALIZER and SPLIT say; that is checked, and for another one every text goes to the library whole. So do texts
    with characters beyond Latin-1 (whose normal form could reach across) or special strings. Chunks with an apostrophe
    are units of their own.
    """

    def __init__(self, tokenizer_file: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(tokenizer_file)
        vocab = self.tk.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for x, i in vocab.items():
            self.ends[i] = x.endswith(WORD_END)
        self.sound = self._is_sound()
        self.special = [x.content for x in self.tk.get_added_tokens_decoder().values()]
        self.kind = _classes()
        self.lower = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256)], np.uint8)
        self.most, self.known, self.ids = most, {}, []

    def _is_sound(self) -> bool:
        own = json.loads(self.tk.to_str())
        splits = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = splits[0] if len(splits) == 2 and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] else {}
        split = first.get("pattern", {}).get("Regex") == SPLIT and first.get("behavior") == "Removed" and first.get("invert")
        return bool(own["normalizer"] == NORMALIZER and split and own["model"]["type"] == "BPE" and own["model"]["end_of_word_suffix"] == WORD_END and not own["model"]["dropout"])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tk.encode_batch(texts, add_special_tokens=False)]

    def learn(self, units: list[bytes], odd: set[bytes]) -> None:
        plain = [x for x in units if x not in odd]
        if plain:
            ids = np.array(self.tk.encode(b" ".join(plain).decode("latin-1"), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):
                flat, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                for i, x in enumerate(plain):
                    self.known[x] = flat[bounds[i] : bounds[i + 1]]
            else:
                odd = odd | set(plain)
        odd_units = [x for x in units if x in odd]
        for x, own in zip(odd_units, self.whole([x.decode("latin-1") for x in odd_units]), strict=True):
            self.known[x] = own.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.sound:
            return self.whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        fast, parts = [], []
        for i, x in enumerate(texts):
            try:
                b = x.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if not any(s in x for s in self.special):
                fast.append(i)
                parts.append(b)
        slow = sorted(set(range(len(texts))) - set(fast))
        for i, own in zip(slow, self.whole([texts[i] for i in slow]), strict=True):
            out[i] = own
        if fast:
            for i, own in zip(fast, self.units(parts), strict=True):
                out[i] = own
        return out

    def units(self, parts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in parts])
        kind = self.kind[data]
        solid = kind != 0
        first = solid & (kind == 2)
        first[0] = solid[0]
        first[1:] |= solid[1:] & (kind[1:] != kind[:-1])
        apostrophe = np.flatnonzero(data == 39)
        if len(apostrophe):
            opens = solid.copy()
            opens[1:] &= ~solid[:-1]
            chunk = np.cumsum(opens, dtype=np.int32)
            marked = np.zeros(chunk[-1] + 1, bool)
            marked[chunk[apostrophe]] = True
            first &= opens | ~marked[chunk]
        chars = self.lower[data[solid]]
        offsets = np.append(np.cumsum(solid, dtype=np.int32)[first] - 1, len(chars)).astype(np.int32)
        if not len(chars):
            return [np.zeros(0, np.uint32)] * len(parts)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars)]).dictionary_encode()
        codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known.clear()
        new = [x for x in values if x not in self.known]
        if new:
            self.learn(new, {x for x in new if b"'" in x})
        own = [self.known[x] for x in values]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        flat, begin = np.frombuffer(b"".join(own), np.uint32), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = sizes[codes]
        place = np.cumsum(n) - n
        ids = flat[np.repeat(begin[codes] - place, n) + np.arange(n.sum())]
        bounds = np.append(place, len(ids))[np.cumsum(first, dtype=np.int32)[ends - 1]]
        return [ids[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of at most `capacity` ids of each text followed by `end_id`: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    own = columns(docs, [id_col, text_col])
    id_type = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_file)
        for x in bounded(batches, 1000, 8 << 20):  # units that texts share are looked up once a batch
            who, rows, ids = [], [], []
            for i, own in enumerate(e.encode(pc.fill_null(x.column(1).cast(pa.string()), "").to_pylist())):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                for p, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    who.append(i)
                    rows.append((p, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part)
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            arrays = [x.column(0).take(pa.array(who)), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return own.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


# ---- patterns -----------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by active sets: the column of steepest descent enters, negative ones leave."""
    ata, atb = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = np.where(active, -np.inf, atb - ata @ x)
        enter = int(np.argmax(slope))
        if slope[enter] <= 1e-7 * max(1.0, float(np.abs(atb).max())):
            break
        active[enter] = True
        while True:
            on = np.flatnonzero(active)
            want = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if (want > 0).all():
                x[:] = 0
                x[on] = want
                break
            down = want <= 0
            step = np.min(x[on][down] / np.maximum(x[on][down] - want[down], 1e-300))
            x[on] += step * (want - x[on])
            active[on[down & (x[on] <= 1e-9)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(n: int) -> list[tuple[int, ...]]:
    """All ways to fill n by one to three parts, the largest first."""
    two = [(n - i, i) for i in range(1, n // 2 + 1)]
    three = [(n - i - j, j, i) for i in range(1, n // 3 + 1) for j in range(i, (n - i) // 2 + 1)]
    return [(n,), *two, *three]


def plan(histogram: dict[int, int], capacity: int, steps: int = 128) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of alike sequences: (how many, [(length, times), ...]). All counts of the histogram are used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    unit = max(1, capacity // steps)
    coarse = np.zeros(capacity // unit + 1)
    np.add.at(coarse, np.minimum((np.arange(capacity + 1) + unit // 2) // unit, capacity // unit), left)
    fits = patterns(capacity // unit)
    a = np.zeros((capacity // unit, len(fits)), np.float32)
    for j, parts in enumerate(fits):
        for p in parts:
            a[p - 1, j] += 1
    repeats = np.floor(nnls(a.astype(float), coarse[1:]) + 1e-6).astype(np.int64) if coarse[1:].any() else np.zeros(len(fits), np.int64)
    there = sorted(np.flatnonzero(left).tolist())

    def nearest(most: int, least: int = 1) -> int:
        """The largest length there is in [least, most], else 0."""
        i = bisect.bisect_right(there, most) - 1
        while i >= 0 and left[there[i]] == 0:
            del there[i]
            i = bisect.bisect_right(there, most) - 1
        return there[i] if i >= 0 and there[i] >= least else 0

    for j in np.argsort([-f[0] for f in fits], kind="stable"):
        todo = int(repeats[j])
        while todo > 0:
            chosen, room = [], capacity
            for i, p in enumerate(fits[j]):
                last = i == len(fits[j]) - 1
                least, most = max(1, p * unit - unit // 2), min(room, p * unit + (unit - 1) // 2)
                length = nearest(room, max(1, least - 2 * unit)) if last and i else nearest(most, least)
                if not length or left[length] <= chosen.count(length):
                    break
                chosen.append(length)
                room -= length
            if len(chosen) < len(fits[j]):
                break
            times = {x: chosen.count(x) for x in chosen}
            k = min(todo, *[int(left[x]) // m for x, m in times.items()])
            if k <= 0:
                break
            for x, m in times.items():
                left[x] -= k * m
            groups.append((k, list(times.items())))
            todo -= k
    return best_fit(groups, left, capacity)


def best_fit(groups: list[tuple[int, list[tuple[int, int]]]], left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Put what is left, longest first, where the gap is smallest; open new sequences where none has room. By counts."""
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for n, items in groups:
        rooms.setdefault(capacity - sum(x * m for x, m in items), []).append((n, items))
    gaps = sorted(rooms)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                each = capacity // length
                new, rest = divmod(n, each)
                made = [(new, [(length, each)])] * bool(new) + [(1, [(length, rest)])] * bool(rest)
                n = 0
            else:
                gap = gaps[i]
                k, items = rooms[gap].pop()
                if not rooms[gap]:
                    del rooms[gap], gaps[i]
                each = min(gap // length, max(1, n // k))
                use = min(k, n // each)
                made = [(use, [*items, (length, each)])]
                if use < k:
                    made.append((k - use, items))
                n -= use * each
            for k, items in made:
                room = capacity - sum(x * m for x, m in items)
                if room not in rooms:
                    bisect.insort(gaps, room)
                rooms.setdefault(room, []).append((k, items))
    return [x for gap in sorted(rooms) for x in rooms[gap]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, times a sequence, first offset), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, items in groups:
        offset = 0
        for length, times in items:
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, sequence, times, offset))
            ranks[length] = first + n * times
            offset += length * times
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def ranked(pieces: DataFrame, row: str) -> DataFrame:
    """`pieces` with rank: 0, 1, ... among those of the same length. A length is ranked in SALTS parts, side by side, into
    which rows are dealt by their number `row`, so copies and rows of one id or none are dealt as evenly as others."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(row)) - 1
    return salted.withColumn("_own", own).join(counts, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_salt", "_own", "_before")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A null or empty text is one piece of `end_id` alone. Repeated rows are pieces of their own, each with its own place.
    Null ids are kept. Only texts of more than `capacity` ids are cut. An empty table gives an empty result. Other
    columns are ignored, whatever their names. What reaches the driver is a histogram of at most `capacity` lengths.
    """
    spark = docs.sparkSession
    found = token_pieces(columns(docs, [id_col, text_col]).toDF("doc", "text"), tokenizer_file, capacity, end_id, "doc", "text", with_ids)
    numbered = stash(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    pieces = numbered.drop("row")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    names = pieces.columns
    rows = ranked(numbered, "row").select(*names, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length, rank = x.column("length").to_numpy(), x.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    t = table.value[int(length[own[0]])]
                    t = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                    nth = rank[own] - t[:, 0]
                    sequence[own] = t[:, 1] + nth // t[:, 2]
                    offset[own] = t[:, 3] + nth % t[:, 2] * length[own]
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    out = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)
