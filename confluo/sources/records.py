"""Readers and writers of records, evidence and backups, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from confluo.functions import text
from confluo.functions.urls import parts

#: What a source record holds; `seq` is the order of input.
SOURCE_RECORD = """seq long, source_id string, source_name string, source_type string, source_url string, source_event_id string, fetched_at timestamp, title string,
artist_names array<string>, venue_name string, venue_id_hint string, date string, open_time string, start_time string, purchase_urls array<string>, prices_jpy array<long>, status_hint string"""


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of JSON files (whole arrays or a record a file); an absent path gives an empty frame, broken records a `_corrupt_record`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def canonical_record(df: DataFrame, hashed: list[str]) -> DataFrame:
    """df with content_hash over the columns in `hashed`, nulls included, in that order."""
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*hashed), {"ignoreNullFields": "false"}), 256))


def api_events(raw: DataFrame, body: str = "content") -> DataFrame:
    """Rows of an API page: title, date, start_time, venue_name, prices_jpy. Without title, date or venue: dropped."""
    schema = "_embedded struct<events:array<struct<id:string,name:string,url:string,dates:struct<start:struct<localDate:string,localTime:string>>,priceRanges:array<struct<currency:string,min:double,max:double>>,_embedded:struct<venues:array<struct<name:string>>>>>>"
    e = raw.select(F.posexplode(F.from_json(body, schema)["_embedded"]["events"]).alias("pos", "e"))
    ranges = F.filter("e.priceRanges", lambda r: r["currency"] == "JPY")
    prices = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.array(F.round(r["min"]).cast("long"), F.round(r["max"]).cast("long")))))
    out = e.select("pos", F.col("e.id").alias("source_event_id"), F.col("e.name").alias("title"), F.col("e.dates.start.localDate").alias("date"), F.substring("e.dates.start.localTime", 1, 5).alias("start_time"), F.try_element_at(F.col("e._embedded.venues"), F.lit(1))["name"].alias("venue_name"), prices.alias("prices_jpy"))
    return out.filter("title is not null and date is not null and venue_name is not null")


def arena_shows(raw: DataFrame, opens: str = "opens", starts: str = "starts") -> DataFrame:
    """A row for each start time, with the opening time of the same place, else the first."""
    return raw.select("*", F.posexplode_outer(starts).alias("show", "start_time")).withColumn("open_time", F.coalesce(F.get(opens, F.col("show")), F.get(opens, F.lit(0))))


def append_evidence(df: DataFrame, path: str) -> None:
    """Bodies with their metadata, by source and batch; never overwritten."""
    df.withColumn("content_hash", F.sha2("content", 256)).write.mode("append").partitionBy("source_id", "batch_id").parquet(path)


def broken_evidence(df: DataFrame) -> DataFrame:
    """Rows whose stored hash is not that of their body."""
    return df.filter(~F.sha2("content", 256).eqNullSafe(F.col("content_hash")))


def manifest(df: DataFrame) -> DataFrame:
    """Per source: attempts, successes (what came from the cache included), failures."""
    ok = F.col("fetch_status").isin("success", "cache_reused")
    return df.groupBy("source_id").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))


def to_backup(df: DataFrame, version: int, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(F.lit(version).alias("version"), F.struct(*columns).alias("data"))).alias("backup"))


def from_backup(df: DataFrame, schema: str, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(restored, ignored) rows of backups: a row counts as restored if its key is known."""
    rows = df.select(F.from_json("backup", f"version int, data struct<{schema}>")["data"].alias("d")).select("d.*")
    return rows.join(known.select(key), key, "left_semi"), rows.join(known.select(key), key, "left_anti")


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """A line of a Markdown table for each row."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def stale_exports(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose exported row is missing, left over or different."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    a, b = digest(old).withColumnRenamed("h", "old"), digest(new).withColumnRenamed("h", "new")
    return a.join(b, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select(key)


def access_restricted(html: Column, url: Column) -> Column:
    """A page behind a wall: phrases of a wall in the visible text, a password field with a login word, or a login path."""
    words, out = text.visible_text(html), F.lit(False)
    for pattern in text.WALLS:
        out = out | words.rlike(pattern)
    login = F.coalesce(html, F.lit("")).rlike(text.PASSWORD_FIELD) & words.rlike(text.LOGIN_WORD)
    return out | login | F.coalesce(parts(url)["path"].rlike(text.LOGIN_PATH), F.lit(False))
