"""Personal data by a semi-Markov conditional random field over whole spans.

The valid matches of the base patterns always stay: they are pinned, so every segmentation must pass through them. Between
them lie zones, runs of characters of which keys, addresses and numbers are made. A zone is cut into atoms at its separators
(`=`, `/`, `-`, `.` and so on), and every stretch of at most `MOST_ATOMS` atoms is a candidate segment; an atom may be of any
length. A candidate and a type are scored as a whole: length, mix and order of characters, separators within, what stands
on either side, the words before. Entities that are near each other add a weight for their pair of types; text outside of
entities scores nothing. Dynamic programming over the cut points sums (or takes the best of) all segmentations at once,
so boundaries and types are chosen jointly. Weights are learned by gradient ascent on the log-likelihood of synthetic
lines, seeded, on the driver, and sent with the job.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import bounded, columns

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "secret")
#: Characters of the shortest segment that is scored, atoms of the longest, characters between neighbours, and characters
#: before a segment that are looked at.
LEAST, MOST_ATOMS, NEAR, BEFORE = 12, 12, 40, 24

#: Fixed patterns. Digits are those of ASCII.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ZONE = re.compile(r"[A-Za-z0-9+/_=.:~-]{12,}+")
DIGIT = re.compile("[0-9]")
HINT = re.compile(r"(token|secret|passw|pwd|key|auth|credential|bearer)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at != -1:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid matches of the base patterns, leftmost and non-overlapping by kind."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".") if len(p) < 300) and all(len(p) < 300 or not p.lstrip("0")[:4] for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def by_place(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    order = {k: i for i, k in enumerate(TYPES)}
    return sorted(spans, key=lambda x: (x[1], order[x[0]], x[2]))


def regions(base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, by start; those that overlap are one region of the first one's type."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in base:
        if out and a < out[-1][2]:
            out[-1] = (*out[-1][:2], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


# ---- candidate segments and their features ------------------------------------------------------------------------


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS, UPPER, LOWER = _flags(bytes(range(48, 58))), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
ALNUM, HEX, VOWELS = DIGITS | UPPER | LOWER, _flags(b"0123456789abcdefABCDEF"), _flags(b"aeiouAEIOU")
SEPARATORS = b"-.:/_+=~"
#: Neighbouring characters by class: none or white space, quotes, each separator, letters and digits, others.
SIDES = {**dict.fromkeys(" \t\n\r", 0), "": 0, '"': 1, "'": 1, "`": 1, **{chr(c): 2 + i for i, c in enumerate(SEPARATORS)}, **dict.fromkeys(map(chr, np.flatnonzero(ALNUM)), 10)}
LENGTHS = (16, 20, 24, 32, 33, 40, 41, 48, 64, 65, 128, 256)
ATOM_LENGTHS = (4, 6, 8, 12, 16, 24, 32, 48)
#: How many values each feature has.
SIZES = (len(LENGTHS) + 1, 5, 4, 6, 6, 8, len(ATOM_LENGTHS) + 1, 3, 12, 12, 4, 11, 9, 9, 10, 12, 10, 10, 5)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


class Segments:
    """The candidates of some texts: doc, start, end of each, by doc, start and end, and a column of `cells` a feature."""

    def __init__(self, texts: list[str], pinned: list[list[tuple[str, int, int]]]):
        zones = []
        for d, text in enumerate(texts):
            if DIGIT.search(text):
                at = 0
                for a, b in [*[(a, b) for _, a, b in pinned[d]], (len(text), len(text))]:
                    zones += [(d, m.start(), m.end()) for m in ZONE.finditer(text, at, a) if DIGIT.search(text, m.start(), m.end())]
                    at = b
        self.doc = self.start = self.end = np.zeros(0, np.int64)
        self.cells = np.zeros((0, len(SIZES)), np.int64)
        if zones:
            self._cut(texts, zones)

    def _cut(self, texts: list[str], zones: list[tuple[int, int, int]]) -> None:
        flat = np.frombuffer("".join(texts[d][a:b] for d, a, b in zones).encode("ascii"), np.uint8)
        of, begin, size = (np.array(x, np.int64) for x in zip(*[(d, a, b - a) for d, a, b in zones], strict=True))
        zone = np.repeat(np.arange(len(zones)), size)
        shift = begin - (np.cumsum(size) - size)  # from places in `flat` to places in the text
        solid, apart = ALNUM[flat], np.flatnonzero(np.diff(zone, prepend=-1))
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[apart] = solid[apart]
        last[apart[1:] - 1] = solid[apart[1:] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            return
        sign = np.append(flat == 61, [False] * 3)
        inside = np.append(zone, [-1] * 3)
        pad = np.where(sign[e] & (inside[e] == zone[s]), 1 + (sign[e + 1] & (inside[e + 1] == zone[s])), 0)
        after = e + pad
        pad[np.append(solid, [False] * 3)[after] & (inside[after] == zone[s])] = 0  # `=` that does not end a key
        sums = {k: np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for k, v in (("d", DIGITS[flat]), ("u", UPPER[flat]), ("l", LOWER[flat]), ("v", VOWELS[flat]), ("x", HEX[flat]))}
        letters = UPPER[flat] | LOWER[flat]
        turn = np.zeros(len(flat), bool)
        turn[1:] = solid[1:] & solid[:-1] & (letters[1:] != letters[:-1])
        sums["w"] = np.concatenate([[0], np.cumsum(turn, dtype=np.int64)])
        for i, c in enumerate(SEPARATORS):
            sums[i] = np.concatenate([[0], np.cumsum(flat == c, dtype=np.int64)])
        a, b, heads, tails, marks = [], [], [], [], []
        numbered = sums["d"][e] > sums["d"][s]
        for k in range(min(MOST_ATOMS, len(s))):
            i = np.flatnonzero(zone[s[: len(s) - k]] == zone[s[k:]])
            for extra in (0, 1):
                j = i[pad[i + k] > 0] if extra else i
                a.append(s[j])
                b.append(e[j + k] + pad[j + k] * extra)
                for ends, at in ((heads, j), (tails, j + k)):
                    ends.append(np.where(k, 1 + np.searchsorted(ATOM_LENGTHS, e[at] - s[at], side="right"), 0))
                marks.append(np.where(k, 1 + 2 * numbered[j] + numbered[j + k], 0))
        a, b, heads, tails, marks = (np.concatenate(x) for x in (a, b, heads, tails, marks))
        order = np.lexsort((b, a))
        order = order[((b - a >= LEAST) & (sums["d"][b] > sums["d"][a]))[order]]
        a, b, heads, tails, marks = (x[order] for x in (a, b, heads, tails, marks))
        z = zone[a]
        self.doc, self.start, self.end = of[z], a + shift[z], b + shift[z]
        self.cells = self._features(texts, a, b, {k: v[b] - v[a] for k, v in sums.items()}, [heads, tails, marks])

    def _features(self, texts: list[str], a: np.ndarray, b: np.ndarray, n: dict, ends: list[np.ndarray]) -> np.ndarray:
        size, letters = b - a, n["u"] + n["l"]
        kinds = np.stack([n[i] for i in range(len(SEPARATORS))])
        seps = kinds.sum(axis=0)
        some = kinds > 0
        key_like = ~some[[0, 1, 2, 4, 7]].any(axis=0)  # no others than + / =
        which = np.where(seps == 0, 0, np.where(some.sum(axis=0) == 1, 1 + some.argmax(axis=0), np.where(key_like, 9, 10)))
        hexes = n["x"] == n["d"] + letters
        left, right, hint = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        seen: tuple[int, int] = (-1, -1)
        for i, (d, x, y) in enumerate(zip(self.doc.tolist(), self.start.tolist(), self.end.tolist(), strict=True)):
            text = texts[d]
            if (d, x) != seen:
                before = text[max(0, x - BEFORE) : x]
                seen, here = (d, x), (SIDES.get(before[-1:], 11), 2 * bool(HINT.search(before)) + before.rstrip(" \"'").endswith(("=", ":")))
            left[i], hint[i] = here
            right[i] = SIDES.get(text[y : y + 1], 11)
        none = letters == 0
        cells = [
            np.searchsorted(LENGTHS, size, side="right"), np.rint(4 * n["d"] / size).astype(np.int64), (n["u"] > 0) + 2 * (n["l"] > 0), np.minimum(5, 20 * n["w"] // size), np.where(none, 5, 4 * n["v"] // np.maximum(1, letters)),
            np.searchsorted((1, 2, 3, 4, 5, 6, 8), seps, side="right"), np.searchsorted(ATOM_LENGTHS, (size - seps) // (seps + 1), side="right"), np.where(hexes, 1 + ((seps == 0) & np.isin(size, (32, 40, 64, 128))), 0),
            left, right, hint, which, np.where(none, np.minimum(8, 1 + np.searchsorted((10, 11, 12, 13, 14, 17), n["d"], side="right")), 0), np.where(none, 1 + np.minimum(7, seps), 0), np.minimum(9, n[2]), 3 * hint + np.where(none, 2, np.where(n["w"] >= 3, 1, 0)), *ends,
        ]
        return np.stack(cells, axis=1) + OFFSETS


# ---- the field ----------------------------------------------------------------------------------------------------


def log_sum(x: np.ndarray) -> np.ndarray:
    """Over the first axis; minus infinity where nothing is."""
    top = x.max(axis=0)
    none = np.isneginf(top)
    return np.where(none, top, top + np.log(np.exp(x - np.where(none, 0.0, top)).sum(axis=0) + none))


class Chain:
    """Segments that are near one another, pinned ones among them, by start and end; scores (segments, types)."""

    def __init__(self, starts: list[int], ends: list[int], pinned: list[bool], scores: np.ndarray, steps: np.ndarray):
        self.starts, self.ends, self.pinned, self.s, self.t = starts, ends, pinned, scores, steps
        self.points = sorted({*starts, *ends})
        self.opens: dict[int, list[int]] = {}
        self.closes: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            self.opens.setdefault(a, []).append(i)
            self.closes.setdefault(b, []).append(i)

    def forward(self) -> tuple[dict, dict, float]:
        """Of each start, the sum over all that may come before it, by type of what starts; of each end, that of all
        segmentations whose last entity ends there, by type; the sum of all."""
        before, done = {}, {}
        far, near = 0.0, []
        for p in self.points:
            while near and p - near[0][0] > NEAR:
                far = np.logaddexp(far, log_sum(near.pop(0)[1]))
            if p in self.closes:
                own = self.closes[p]
                done[p] = log_sum(np.stack([before[self.starts[i]] + self.s[i] for i in own]))
                if any(self.pinned[i] for i in own):
                    far, near = -np.inf, []  # nothing passes by a pinned span
                near.append((p, done[p]))
            if p in self.opens:
                ways = [np.full((1, len(self.t)), far)] + [e[:, None] + self.t for _, e in near]
                before[p] = log_sum(np.concatenate(ways))
        return before, done, float(np.logaddexp(far, log_sum(np.concatenate([e for _, e in near]))) if near else far)

    def expect(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of (segment, type), expected counts of pairs of neighbouring types, the log of the sum."""
        before, done, z = self.forward()
        after: dict[int, np.ndarray] = {}
        pairs = np.zeros_like(self.t)
        marginals = np.zeros_like(self.s)
        far, near = 0.0, []
        for p in reversed(self.points):
            while near and near[0][0] - p > NEAR:
                far = np.logaddexp(far, log_sum(near.pop(0)[1]))
            if p in self.opens and p not in self.closes:
                far, near = self._open(p, after, far, near)
            elif p in self.closes:
                # What starts here may follow what ends here, so starts come first.
                if p in self.opens:
                    far, near = self._open(p, after, far, near)
                ways = [np.full((1, len(self.t)), far)] + [(self.t + s).T for _, s in near]
                after[p] = log_sum(np.concatenate(ways))
                for _, s in near:
                    pairs += np.exp(done[p][:, None] + self.t + s - z)
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            marginals[i] = np.exp(before[a] + self.s[i] + after[b] - z)
        return marginals, pairs, z

    def _open(self, p: int, after: dict, far, near: list) -> tuple:
        own = self.opens[p]
        here = log_sum(np.stack([self.s[i] + after[self.ends[i]] for i in own]))
        if any(self.pinned[i] for i in own):
            far, near = -np.inf, []
        return far, [*near, (p, here)]

    def best(self) -> list[tuple[int, int]]:
        """The best segmentation, as (segment, type); of equal ones that with fewer entities."""
        k = len(self.t)
        came: dict[int, list] = {}  # of each start and type, the end and type that come before
        value: dict[int, np.ndarray] = {}
        last: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each end and type, the best value and its segment
        far, near = (0.0, None), []
        for p in self.points:
            while near and p - near[0] > NEAR:
                q = near.pop(0)
                m = int(last[q][0].argmax())
                if last[q][0][m] > far[0]:
                    far = (float(last[q][0][m]), (q, m))
            if p in self.closes:
                own = self.closes[p]
                each = np.stack([value[self.starts[i]] + self.s[i] for i in own])
                last[p] = (each.max(axis=0), np.array(own)[each.argmax(axis=0)])
                if any(self.pinned[i] for i in own):
                    far, near = (-np.inf, None), []
                near.append(p)
            if p in self.opens:
                value[p], came[p] = np.full(k, far[0]), [far[1]] * k
                for q in near:
                    link = last[q][0][:, None] + self.t
                    top = link.argmax(axis=0)
                    for m in range(k):
                        if link[top[m], m] > value[p][m]:
                            value[p][m], came[p][m] = link[top[m], m], (q, int(top[m]))
        for q in near:
            m = int(last[q][0].argmax())
            if last[q][0][m] > far[0]:
                far = (float(last[q][0][m]), (q, m))
        out, at = [], far[1]
        while at is not None:
            i = int(last[at[0]][1][at[1]])
            out.append((i, at[1]))
            at = came[self.starts[i]][at[1]]
        return out[::-1]


class SpanModel:
    def __init__(self, seed: int = 3, lines: int = 500, epochs: int = 14, rate: float = 1.0, decay: float = 2e-4):
        self.w, self.t = np.zeros((sum(SIZES), len(TYPES))), np.zeros((len(TYPES), len(TYPES)))
        texts, golds = zip(*[synthetic(random.Random(f"{seed}:{i}")) for i in range(lines)], strict=True)
        pinned = [regions(by_place(base_spans(x))) for x in texts]
        segments = Segments(list(texts), pinned)
        squares = [np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)]
        for _ in range(epochs):
            scores = self.scores(segments)
            slope, pairs = np.zeros_like(scores), np.zeros_like(self.t)
            for d, own, chain in self.chains(segments, pinned, scores):
                marginals, expected, _ = chain.expect()
                pairs -= expected
                before = None
                for i, at in enumerate(own):
                    span = (chain.starts[i], chain.ends[i])
                    kind = golds[d].get(span) if at >= 0 else TYPES[int(chain.s[i].argmax())]
                    if at >= 0:
                        slope[at] -= marginals[i]
                    if kind is not None:
                        k = TYPES.index(kind)
                        if at >= 0:
                            slope[at, k] += 1
                        if before is not None and 0 <= span[0] - before[0] <= NEAR:
                            pairs[before[1], k] += 1
                        before = (span[1], k)
            step = np.zeros_like(self.w)
            for j in range(len(SIZES)):
                np.add.at(step, segments.cells[:, j], slope)
            for x, g, q in zip((self.w, self.t), (step, pairs), squares, strict=True):
                g = g / lines - decay * x
                q += g**2
                x += rate * g / np.sqrt(q)

    def scores(self, segments: Segments) -> np.ndarray:
        return self.w[segments.cells].sum(axis=1)

    def chains(self, segments: Segments, pinned: list[list[tuple[str, int, int]]], scores: np.ndarray, most: np.ndarray | None = None) -> Iterator[tuple[int, list[int], Chain]]:
        """(doc, of each segment its place in `segments` or -1 if pinned, chain): per text the segments that are within NEAR of
        each other. With `most` (the most each segment can add), only chains in which something could."""
        edges = np.searchsorted(segments.doc, np.arange(len(pinned) + 1))
        for d in np.unique(segments.doc).tolist():
            a, b = int(edges[d]), int(edges[d + 1])
            own = sorted([*zip(segments.start[a:b].tolist(), segments.end[a:b].tolist(), range(a, b), strict=True), *[(x, y, -1 - TYPES.index(k)) for k, x, y in pinned[d]]])
            at = 0
            while at < len(own):
                stop, reach = at + 1, own[at][1]
                while stop < len(own) and own[stop][0] - reach <= NEAR:
                    reach = max(reach, own[stop][1])
                    stop += 1
                part, at = own[at:stop], stop
                found = [x[2] for x in part if x[2] >= 0]
                if not found or (most is not None and not (most[found] > 0).any()):
                    continue
                s = np.full((len(part), len(TYPES)), -np.inf)
                for i, x in enumerate(part):
                    if x[2] >= 0:
                        s[i] = scores[x[2]]
                    else:
                        s[i, -1 - x[2]] = 0.0
                yield d, [max(x[2], -1) for x in part], Chain([x[0] for x in part], [x[1] for x in part], [x[2] < 0 for x in part], s, self.t)

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """Per text the base spans, and all: with the segments of the best segmentation. By start, then type."""
        base = [by_place(base_spans(x)) for x in texts]
        pinned = [regions(x) for x in base]
        segments = Segments(texts, pinned)
        scores = self.scores(segments)
        # An entity adds its score and the links to both sides at most, so a chain in which none can add anything is left out.
        most = scores.max(axis=1, initial=-np.inf) + 2 * max(0.0, float(self.t.max()))
        added: dict[int, list[tuple[str, int, int]]] = {}
        for d, own, chain in self.chains(segments, pinned, scores, most):
            added.setdefault(d, []).extend((TYPES[k], chain.starts[i], chain.ends[i]) for i, k in chain.best() if own[i] >= 0)
        return [(b, by_place([*b, *added[d]]) if added.get(d) else b) for d, b in enumerate(base)]


# ---- what it learns from ------------------------------------------------------------------------------------------


def synthetic(r: random.Random) -> tuple[str, dict[tuple[int, int], str]]:
    """A line of invented words with typed spans, and look-alikes that are none."""
    word = lambda: "".join(r.choice("abdefghilmnoprstuvwz") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9])))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    key = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n - 2)) + number(2)
    lower = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 2)) + number(2)
    wide = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n - 3)) + key(3) + r.choice(["", "=", "=="])

    def card() -> str:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        d = number(r.choice([12, 13, 15, 16, 18]))
        return d[:-1] + next(c for c in "0123456789" if not luhn(d[:-1] + c))

    def secret() -> str:
        return r.choice([
            lambda: hexes(r.choice([32, 40, 64])), lambda: key(r.randint(20, 48)), lambda: key(r.randint(20, 40)), lambda: lower(r.randint(20, 40)), lambda: wide(r.randint(24, 64)), lambda: key(r.randint(60, 400)),
            lambda: f"{r.choice(['sk', 'pk', 'rk'])}_{r.choice(['live', 'test'])}_{key(24)}", lambda: f"{r.choice(['ghp', 'gho', 'glp'])}_{key(36)}", lambda: f"{word()[:4]}-{number(11)}-{key(24)}", lambda: f"{key(36)}.{key(60)}.{key(43)}",
        ])()

    made = {
        "email": lambda: f"{word()}.{r.randint(1, 99)}@{word()}.example.com", "ip": lambda: r.choice([".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(hexes(4) for _ in range(8))]), "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", f"{r.randint(201, 989)}-{number(3)}-{number(4)}"]), "secret": secret,
    }
    like = (
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}", lambda: f"isbn-{number(13)}-{word()}", lambda: f"/{word()}/{word()}/{word()}{r.randint(1, 9)}/{word()}", lambda: f"{r.randint(1990, 2030)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}:{number(2)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{word()}.{r.randint(1, 9)}", lambda: f"https://{word()}.example.org/{word()}/{word()}-{word()}-{r.randint(1, 99999)}.html", lambda: f"{word()}_{word()}_{r.randint(1, 2030)}_{word()}.pdf", no_card, no_card, lambda: number(r.randint(20, 30)),
        lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"978-{r.randint(0, 9)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"{number(3)}-{number(7)}-{number(7)}", lambda: f"{word()}={r.randint(1, 999)}&{word()}={word()}{r.randint(1, 99)}",
        lambda: ":".join(hexes(2) for _ in range(6)), lambda: f"{number(2)}:{number(2)}:{number(2)}-{number(2)}:{number(2)}:{number(2)}", lambda: f"{word()}{word()}{word()}{r.randint(0, 99)}", lambda: f"{r.randint(1, 9)}.{number(12)}", lambda: f"{word()}.{word()}.{word()}{r.randint(1, 9)}.{word()}",
    )
    text, gold = " ".join(word() for _ in range(r.randint(2, 6))) + " ", {}
    for _ in range(r.randint(1, 3)):
        kind = r.choice([*TYPES, "secret", "none", "none", "none"])
        if kind == "none":
            text += r.choice(["", "", '"', "(", "key: "]) + r.choice(like)()
        else:
            x, tail = made[kind](), ""
            if kind == "secret":
                lead, tail = r.choice([('token = "', '"'), ('"api_key": "', '",'), ("secret=", ""), ("password=", ""), ("password = '", "'"), ("token ", ""), ('key = "', '"'), ("Authorization: Bearer ", ""), (f"https://{word()}.example.org/{word()}?auth_token=", f"&{word()}={r.randint(1, 99)}"), ("api-key:", ""), (f"{word()}/{word()}/", f"/{word()}"), (f"{word()}/{word()}/{word()}/", f"/{word()}"), (f"/{word()}/", ""), (f"https://{word()}.example.org/{word()}/", f"/{word()}"), (f"{word().upper()}_SECRET=", ""), ("", "")])
                text += lead
            begin = len(text)
            text += x
            gold[begin, len(text)] = kind
            text += tail
        text += r.choice([" ", " ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(1, 12))) + " "
    return text, gold


@lru_cache(maxsize=1)
def model() -> SpanModel:
    """The one model of this process: trained once, and sent to tasks with the job."""
    return SpanModel()


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans of a text, and all."""
    return model().spans([text])[0]


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and spans (arrays of kind, start, end in code points, end exclusive), counts n_email, n_ip, n_card, n_phone.

    Null and empty texts have no spans. Repeated rows and null ids are kept. An empty table gives an empty result. Other
    columns are ignored. Texts of any length are read whole, and a span may be of any length. What the model adds never
    overlaps a base span; it holds LEAST characters or more, a digit among them, and MOST_ATOMS runs of letters and digits
    at most (a longer key comes as several spans side by side). Of segmentations that score alike, that with fewer spans
    is taken.
    """
    own, m = columns(docs, [id_col, text_col]), model()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bounded(batches):
            found = m.spans(pc.fill_null(x.column(1).cast(pa.string()), "").to_pylist())
            base, every = [b for b, _ in found], [e for _, e in found]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own] for own in spans], pa.list_(span)) for spans in (base, every)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in BASE]
            digest = pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b in base])
            yield pa.RecordBatch.from_arrays([x.column(0), *lists, *counts, digest], [id_col, "base", "spans", *[f"n_{k}" for k in BASE], "base_sha256"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, base {kind}, spans {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string")


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its type in brackets; of overlapping spans the earliest names the place."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def redacted(text: str) -> str:
    return without(text, spans_of(text)[1])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in `text_col` replaced. Null texts stay null, rows without personal
    data stay as they are; repeated rows are kept, and an empty table gives an empty result."""
    m = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bounded(batches):
            i = x.schema.get_field_index(text_col)
            texts = x.column(i).to_pylist()
            found = m.spans([t or "" for t in texts])
            new = pa.array([None if t is None else without(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())
            yield x.set_column(i, x.schema.field(i), new.cast(x.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
