"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a place where both
start a token and that is proven stable: no piece of the vocabulary holds the two characters around it side by side, so
no merge can ever cross it, whatever stands further away. Where an overlap holds no such place it is widened, at last
to the whole rest of the text, so the count always equals that of the text encoded in one go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import bounded, columns

SPACE_SIGN = "▁"  # how the vocabulary writes a space


class PieceCounter:
    """Counts tokens by sentencepiece, without begin, end or added special tokens."""

    def __init__(self, model_file: str, chunk_chars: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.joined = {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No merge can cross the place before text[at]."""
        pair = text[at - 1 : at + 1].replace(" ", SPACE_SIGN)
        return len(pair) == 2 and pair not in self.joined

    def starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of text[begin:end], encoded by itself, start in the text."""
        part = text[begin:end]
        at = np.array([x.begin for x in self.sp.encode(part, return_type="proto").pieces], np.int64)  # in bytes
        leads = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        return np.append(np.cumsum(leads) - 1, len(part))[at] + begin

    def as_written(self, text: str) -> bool:
        """The normaliser leaves the text as it is, but for signs in place of spaces (and one before the text)."""
        written = text.replace(" ", SPACE_SIGN)
        return self.sp.normalize(text) in (written, SPACE_SIGN + written)

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk + self.overlap or not self.as_written(text):
            return len(self.sp.encode(text, num_threads=1))
        overlap, begin, cut, total = self.overlap, 0, 0, 0
        end = min(n, self.chunk + overlap)
        a = self.starts(text, begin, end)
        while end < n:
            b_begin = max(cut, end - overlap)
            b_end = min(n, b_begin + self.chunk + overlap)
            b = self.starts(text, b_begin, b_end)
            both = np.intersect1d(a, b)
            both = both[(both > max(cut, b_begin)) & (both < end)]
            at = next((int(x) for x in both if self.stable(text, int(x))), None)
            if at is not None:
                total += int(np.count_nonzero((a >= cut) & (a < at)))
                begin, cut, end, a, overlap = b_begin, at, b_end, b, self.overlap
                continue
            overlap = min(2 * overlap, n)
            end = min(n, end + overlap)
            a = self.starts(text, begin, end)
        return total + int(np.count_nonzero(a >= cut))

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, x in enumerate(texts) if len(x) <= self.chunk + self.overlap]
        out = [0] * len(texts)
        for i, ids in zip(short, self.sp.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            out[i] = self.count(texts[i])
        return out


@lru_cache(maxsize=4)
def counter(model_file: str, chunk_chars: int, overlap: int) -> PieceCounter:
    return PieceCounter(model_file, chunk_chars, overlap)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 256) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are kept, a row each. An empty table
    gives an empty result. Other columns are ignored, whatever their names. Texts of any length are counted whole.
    """
    own = columns(docs, [id_col, text_col])
    id_type = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file, chunk_chars, overlap)
        for x in bounded(batches):
            text = pc.fill_null(x.column(1).cast(pa.string()), "")
            n_bytes = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0), n_bytes, pa.array(c.counts(text.to_pylist()), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return own.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
