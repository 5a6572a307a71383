"""The queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam, hosts, langid, minhash, mixing, multiset, negatives, packing, pii, rtree, tokens, turns, warc
from .shared import columns, scratch, small_batches, table

#: The largest number of tokens that counts as within the limit.
TOKEN_LIMIT = 4096
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer(PIECES))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget_share=1.5, max_epochs=2.0)
    return columns(out, ["doc_id", "size", "source_size", "target", "taken"])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are measured by the payload that is read back; revisits have none, so theirs is what their headers say. Either
    kind is read by a scan that skips the other's records."""
    path = scratch(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    full, bare = warc.read_archive(spark, path).filter("record_type = 'response'"), warc.read_archive(spark, path, payloads=False).filter("record_type = 'revisit'")
    page, to = F.col("page_id").try_cast("long").alias("page_id"), F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    responses = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = bare.select(page, F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", to.alias("refers_to"))
    return responses.unionByName(revisits)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORDS), capacity=4096, end_id=1)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    one = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256", F.array_join(one, ",").alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = gam.fit(docs, labels)
    return gam.score(docs, model).withColumn("held_out", gam.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.host_rules(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs, model).withColumn("held_out", langid.held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    divides = lambda n: F.col("vec_id") % n == 0
    label = F.when(divides(7), (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), divides(100), label=label)


def op12_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.similar_sets(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")), dropped_col="dropped")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each with the session's Arrow batches bounded, as texts may be long."""

    def with_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return query(spark, sf_dir)

        return run

    own = (op1_token_counts, op2_mixing, op3_near_duplicates, op4_warc, op5_packing, op6_personal_data, op7_quality, op8_host_rules, op9_fingerprints, op10_language, op11_hard_negatives, op12_similar_sets, op13_conversation_repair)
    return {f.__name__: with_small_batches(f) for f in own}


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS place FROM documents),
per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([3, 1, 2], CAST(rk % 3 + 1 AS INTEGER)) AS weight, CAST(source_size AS DOUBLE) * 2.0 AS cap,
         CAST(source_size AS DOUBLE) * 2.0 / list_extract([3, 1, 2], CAST(rk % 3 + 1 AS INTEGER)) AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM per),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, weight * coalesce((SELECT level FROM chosen), 'inf'::DOUBLE)) AS target FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
ranked AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.repeats, CAST(floor(s.target) AS BIGINT) - s.repeats * s.source_size AS remaining,
         coalesce(sum(d.size) OVER (PARTITION BY s.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(repeats * size + greatest(0, least(size, remaining - before)) AS BIGINT) AS taken FROM ranked
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op4_warc": OP4_SQL, "op8_host_rules": hosts.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL, "op12_similar_sets": rtree.ORACLE_SQL, "op13_conversation_repair": turns.ORACLE_SQL}
