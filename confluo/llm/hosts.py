"""Quality rules judged by host: rates of rule failures by domain, shrunk by a beta prior learned from all hosts.

Each text is measured and held against rules of its own. The failures of a host's documents are counted; its rate is
shrunk towards the rate of all hosts by a beta prior whose strength is estimated by moments from how far the hosts'
rates spread beyond chance. A host whose shrunk rate is above `worst_rate` is refused, and that verdict is joined back
to its documents, next to each document's own base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gam import code_groups, line_codes, spans_sum
from .shared import bounded, columns, hinted, stash
from .words import SPACE, batch_words

LEAST_WORDS, WORST_RATE = 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word stands in a window of three words found twice or more in its text."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < 3:
        return covered
    two, _ = code_groups(codes[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[1:])
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    three, _ = code_groups(two[whole].astype(np.int64) * (int(codes.max()) + 1) + codes[whole + 2])
    groups, sizes = code_groups(doc[whole].astype(np.int64) * (int(three.max(initial=0)) + 1) + three)
    hit = whole[sizes[groups] > 1] if len(whole) else whole
    for i in range(3):
        covered[hit + i] = True
    return covered


def measure(text: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text."""
    w = batch_words(text)
    n_docs, doc = len(w.offsets) - 1, w.doc_of()
    chars = spans_sum(~SPACE[w.data] & ((w.data & 0xC0) != 0x80), w.offsets)
    line_doc, codes, worded = line_codes(w.data, w.offsets)
    line_doc, codes = line_doc[worded], codes[worded]
    groups, sizes = code_groups(line_doc * np.int64(int(codes.max(initial=0)) + 1) + codes)
    of = np.zeros(len(sizes), np.int64)
    of[groups] = line_doc
    dup = np.bincount(line_doc, minlength=n_docs) - np.bincount(of, minlength=n_docs)
    repeat = np.bincount(doc, repeated_words(w.codes, doc), n_docs)
    return [x.astype(np.int64) for x in (np.diff(w.docs), chars, spans_sum(SYMBOLS[w.data], w.offsets), dup, repeat)]


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, MEASURES, base_failed (either base rule) and failed (that, or more than a symbol or a repeated line
    for ten words, or words of fewer than 3 or more than 12 characters on average)."""
    own = columns(docs, [id_col, host_col, text_col]).toDF(id_col, "_host", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, measure(b.column(2)))], [id_col, "_host", *MEASURES])

    kinds = [f"`{id_col}` {own.schema[0].dataType.simpleString()}", f"_host {own.schema[1].dataType.simpleString()}", *[f"{m} long" for m in MEASURES]]
    out = own.mapInArrow(run, ", ".join(kinds))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn(
        "failed", F.col("base_failed") | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > F.col("n_words")) | ~F.col("word_chars").between(3 * F.col("n_words"), 12 * F.col("n_words"))
    )


def host_rates(rows: DataFrame, worst_rate: float = WORST_RATE) -> DataFrame:
    """Per host: n, n_failed, shrunk_rate, refused. The prior's mean is the rate of all rows; its strength (between 1 and
    10,000) follows from the spread of the hosts' rates beyond that of chance. One host alone is its own prior."""
    per = rows.filter("_host is not null").groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("n_failed").alias("all_failed"), F.count("*").alias("hosts"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")).alias("squares"))
    mean = F.col("all_failed") / F.col("all_n")
    chance = mean * (1 - mean)
    spread = F.col("squares") / F.col("all_n") - mean * mean - chance * F.col("hosts") / F.col("all_n")
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), chance / spread - 1))).otherwise(F.lit(10_000.0))
    prior = total.select(mean.alias("mean"), strength.alias("strength"))  # a single row
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return per.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", shrunk).withColumn("refused", F.col("shrunk_rate") > worst_rate).drop("mean", "strength")


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", worst_rate: float = WORST_RATE) -> DataFrame:
    """Per row: id, MEASURES, base_failed, kept (neither failed nor of a refused host).

    Null and empty texts have no words and fail. Rows without a host are judged by the base rules alone. Repeated rows
    and null ids are kept as rows of their own. A host whose shrunk rate is `worst_rate` itself is not refused. An empty
    table gives an empty result. Other columns are ignored, whatever their names; texts of any length are measured whole.
    """
    rows = stash(document_rules(docs, id_col, text_col, host_col), "host-rows")
    refused = stash(host_rates(rows, worst_rate).filter("refused").select("_host", "refused"), "refused-hosts")
    joined = rows.join(hinted(refused, refused.count()), "_host", "left")
    return joined.select(id_col, *MEASURES, "base_failed", (~F.col("base_failed") & ~F.coalesce("refused", F.lit(False))).alias("kept"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
tri AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep CROSS JOIN (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars NOT BETWEEN 3 * n_words AND 12 * n_words AS failed FROM r),
h AS (SELECT source, count(*) AS n, sum(CAST(failed AS BIGINT)) AS nf FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(nf) / sum(n) AS mean, sum(n) AS all_n, count(*) AS hosts, sum(nf * nf / n) AS squares FROM h),
s AS (SELECT mean, mean * (1 - mean) AS chance, squares / all_n - mean * mean - mean * (1 - mean) * hosts / all_n AS spread FROM a),
p AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(1.0, least(10000.0, chance / spread - 1)) ELSE 10000.0 END AS strength FROM s),
bad AS (SELECT source FROM h, p WHERE (nf + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f
"""
