"""Stored responses: bodies by their hash, written once, and an entry for each attempt, failures included.

A body is kept once however often it was fetched. Writing reads the hashes that are there, appends what is new by Spark's
committed writers, and never rewrites a file; so a batch that is written again, by a retry of the job or of a task, adds
nothing. Bodies are written before their entries, so no entry is without its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions.checks import file_kind, path_segment

from .folders import exists

# States of a fetch and of its parser.
SUCCESS, REUSED, HTTP_ERROR, FETCH_FAILED = "success", "cache_reused", "http_error", "page_fetch_failed"
NOT_RECORDED, NOT_RUN = "not_recorded", "not_run"
#: Folders that the store's tables are split into, by the first digit of a hash.
BUCKETS = 16

RESPONSE = "source_id string, batch_id string, source_role string, parser_ids array<string>, parser_version string, requested_url string, canonical_url string, attempt int, http_status int, content_type string, fetched_at string, body binary, error string"


def entries_of(responses: DataFrame) -> DataFrame:
    """The responses with content_hash, entry (its name within source and batch), fetch_status, parser_status, parser_errors,
    redirected and raw_file. A response without a body is a failure, with its error; it keeps no url or status of an answer."""
    text = lambda *cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    got = F.col("body").isNotNull()
    rows = responses.withColumn("canonical_url", F.when(got, F.coalesce("canonical_url", "requested_url")))
    rows = rows.withColumn("content_hash", F.sha2("body", 256))
    request = F.substring(F.sha2(text("requested_url", "canonical_url", "attempt"), 256), 1, 12)
    failure = F.sha2(text("requested_url", "source_id", "attempt", "error"), 256)
    status = F.when(~got, FETCH_FAILED).when(F.col("http_status").between(200, 299), SUCCESS).otherwise(HTTP_ERROR)
    path = F.concat_ws("/", F.lit("raw"), path_segment(F.col("source_id")), "batch_id", F.concat_ws(".", "content_hash", file_kind(F.col("content_type"))))
    return rows.withColumns({
        "http_status": F.when(got, F.col("http_status")), "content_type": F.when(got, F.coalesce("content_type", F.lit(""))), "entry": F.when(got, F.concat_ws(".", "content_hash", request)).otherwise(F.concat(failure, F.lit(".fetch-failed"))),
        "fetch_status": status, "parser_status": F.when(got, NOT_RECORDED).otherwise(NOT_RUN), "parser_errors": F.when(got, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("error", F.lit("")))),
        "redirected": got & (F.col("canonical_url") != F.col("requested_url")), "raw_file": F.when(got, path),
    })


ENTRY = ("source_id", "batch_id", "source_role", "parser_ids", "parser_version", "requested_url", "canonical_url", "attempt", "http_status", "content_type", "fetched_at", "content_hash", "entry", "fetch_status", "parser_status", "parser_errors", "redirected", "raw_file")


def bucket(hash_: Column) -> Column:
    return F.substring(hash_, 1, 1)


class EvidenceStore:
    """Tables `bodies` (content_hash, body) and `entries` below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, responses: DataFrame) -> None:
        """Store what is not there yet. responses: RESPONSE."""
        rows = entries_of(responses)
        bodies = rows.filter("content_hash is not null").groupBy("content_hash").agg(F.any_value("body").alias("body"))
        self._append(bodies.withColumn("bucket", bucket(F.col("content_hash"))), "bodies", ["content_hash"])
        entries = rows.select(*ENTRY).dropDuplicates(["source_id", "batch_id", "entry"])
        self._append(entries.withColumn("bucket", bucket(F.col("entry"))), "entries", ["entry", "source_id", "batch_id"])

    def _append(self, new: DataFrame, name: str, key: list[str]) -> None:
        path = f"{self.root}/{name}"
        if exists(self.spark, path):
            old = self.spark.read.schema(new.schema).parquet(path).select("bucket", *[F.col(c).alias(f"_{c}") for c in key])
            same = F.col("n.bucket") == F.col("o.bucket")
            for c in key:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o._{c}"))
            new = new.alias("n").join(old.alias("o"), same, "left_anti").select("n.*")
            if not new.limit(1).count():
                return
        new.repartition(BUCKETS, "bucket").write.mode("append").partitionBy("bucket").parquet(path)

    def bodies(self) -> DataFrame:
        """One row a hash, also where two writers at once have stored a body each."""
        return self.spark.read.parquet(f"{self.root}/bodies").groupBy("content_hash").agg(F.any_value("body").alias("body"))

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/entries").drop("bucket").dropDuplicates(["source_id", "batch_id", "entry"])


def with_parser_results(entries: DataFrame, results: DataFrame) -> DataFrame:
    """The entries with what parsers said of them. results: seq, source_id, url (requested or canonical), parser_id, status,
    error, output_count; the last status and count hold, each error is kept once behind the entry's own."""
    said = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "parser_id", "error"))
    at = F.array_distinct(F.array_compact(F.array("requested_url", "canonical_url")))
    keyed = entries.select("source_id", "batch_id", "entry", F.explode(at).alias("url"))
    hits = keyed.join(results.select("seq", "source_id", "url", "status", "output_count", said.alias("said")), ["source_id", "url"])
    per = hits.groupBy("source_id", "batch_id", "entry").agg(
        F.max_by("status", "seq").alias("_status"), F.max_by("output_count", "seq").alias("output_count"), F.sort_array(F.collect_set(F.when(F.col("said").isNotNull(), F.struct("seq", "said")))).alias("_said"),
    )
    out = entries.join(per, ["source_id", "batch_id", "entry"], "left")
    errors = F.array_distinct(F.concat("parser_errors", F.coalesce(F.transform("_said", lambda x: x["said"]), F.array().cast("array<string>"))))
    return out.withColumns({"parser_status": F.coalesce("_status", "parser_status"), "parser_errors": errors}).drop("_status", "_said")


def latest_success(entries: DataFrame) -> DataFrame:
    """Of each source and url (requested or canonical), the last entry that was fetched or taken from the cache: source_id, url
    and the entry's columns. Ties go to the greater name."""
    at = F.array_distinct(F.array_compact(F.array("requested_url", "canonical_url")))
    good = entries.filter(F.col("fetch_status").isin(SUCCESS, REUSED)).withColumn("url", F.explode(at))
    return good.groupBy("source_id", "url").agg(F.max_by(F.struct(*entries.drop("source_id").columns), F.struct("fetched_at", "attempt", "entry")).alias("r")).select("source_id", "url", "r.*")


def incomplete(entries: DataFrame, bodies: DataFrame, roles: list[str]) -> DataFrame:
    """(entry, rule) for each entry that breaks a rule of manifests: `metadata` (source, role, url, time, parsers or version
    missing), `response` (a success without url, status, type, hash or file), `body missing`, `body changed` (the stored body has
    another hash), `parser not recorded`. bodies: content_hash, body."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    url = lambda c: F.coalesce(F.col(c).rlike(r"^https?://[^\s/?#]+"), F.lit(False))
    real = bodies.select("content_hash", F.sha2("body", 256).alias("_real"))
    rows = entries.join(real, "content_hash", "left")
    good = F.col("fetch_status").isin(SUCCESS, REUSED)
    metadata = blank("source_id") | ~F.coalesce(F.col("source_role").isin(*roles), F.lit(False)) | ~url("requested_url") | blank("fetched_at") | (F.coalesce(F.size("parser_ids"), F.lit(-1)) <= 0) | blank("parser_version")
    response = ~url("canonical_url") | F.col("http_status").isNull() | blank("content_type") | blank("content_hash") | blank("raw_file")
    broken = {"metadata": metadata, "response": good & response, "body missing": good & ~response & F.col("_real").isNull(), "body changed": good & ~response & (F.col("_real") != F.col("content_hash")), "parser not recorded": good & (F.col("parser_status") == NOT_RECORDED)}
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in broken.items()]))
    return rows.select("source_id", "batch_id", "entry", F.explode(found).alias("rule"))
