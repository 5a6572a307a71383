"""Words of whole Arrow batches of texts, as integer codes.

A word is a run of bytes other than ASCII space and \\x09-\\x0D. In UTF-8 that is the same as a run of such
code points, as bytes of longer characters are all above \\x7F.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts (n + 1 offsets). Null: empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.string()), "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    codes: np.ndarray  #: of each word, the place of its value in `values`
    values: pa.Array  #: the distinct words of the batch, as binary
    docs: np.ndarray  #: n + 1 places in `codes`: where each text's words start
    starts: np.ndarray  #: the byte at which each word starts
    lengths: np.ndarray  #: bytes of each word
    data: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.values.to_pylist()), np.uint64, len(self.values))
        return own[self.codes] if len(self.codes) else np.zeros(0, np.uint64)

    def doc_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))


def batch_words(text: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(text)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    solid = data[inside]
    at = np.append((np.cumsum(inside, dtype=np.int64) - 1)[starts], len(solid)).astype(np.int32)
    if lower:
        solid = LOWER[solid]
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(solid))]).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets), starts, np.diff(at), data, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64, fixed constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words, and n + 1 places where each text's windows start.

    A text with fewer words, but at least one, has its whole sequence as one window.
    """
    m = odd_numbers(width, 5)
    n_words = np.diff(docs)
    n_windows = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    places = np.concatenate([[0], np.cumsum(n_windows)])
    of = np.repeat(docs[:-1] - places[:-1], n_windows) + np.arange(places[-1])
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = np.zeros(places[-1], np.uint64)
    for i in range(width):
        out += mix64(padded[of + i] + np.uint64(i)) * m[i] if i else padded[of] * m[0]
    with np.errstate(over="ignore"):
        for d in np.flatnonzero((n_words > 0) & (n_words < width)):
            own, short = hashes[docs[d] : docs[d + 1]], np.uint64(0)
            spread = [own[0], *mix64(own[1:] + np.arange(1, len(own), dtype=np.uint64))]
            for h, by in zip(spread, m, strict=False):
                short += h * by
            out[places[d]] = short + np.uint64(len(own)) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out), places
