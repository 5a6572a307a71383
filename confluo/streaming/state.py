"""Streaming forms of keyed state: evidence appended once, observations upserted, queue jobs rechecked. An extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from confluo.operators import ranking, sets


def append_once(stream: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark, which also bounds the state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than `delay` are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def upsert_batches(stream: DataFrame, folder: str, keys: list[str], at: str, tie: str, checkpoint: str):
    """Keep the latest row of each key as numbered versions of a table in `folder`; a batch that is run again writes the
    same version again, so a lost driver does no harm."""

    def merge(batch: DataFrame, number: int) -> None:
        new = ranking.latest(batch, keys, at, tie)
        old = batch.sparkSession.read.parquet(f"{folder}/v{number - 1}") if number else new.limit(0)
        newer = ranking.latest(old.unionByName(new), keys, at, tie)
        sets.upsert(old, newer, keys).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


class JobStates(StatefulProcessor):
    """The state of each queue job: how often it was tried, its last status; retries are due after a doubling delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "attempts int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, status = self.job.get() if self.job.exists() else (0, "pending")
        for http in pd.concat(list(rows)).sort_values("seq")["http"]:  # a key's rows of one batch, in whatever parts they come
            attempts += 1
            status = "blocked" if http in (401, 403) else "invalid" if 400 <= http < 500 and http != 429 else "deferred" if http >= 500 or http == 429 else "done"
        self.job.update((attempts, status))
        delay = min(60, 2**attempts) if status == "deferred" else None
        yield pd.DataFrame({"url": [key[0]], "attempts": [attempts], "status": [status], "retry_minutes": pd.array([delay], "Int64")})

    def close(self) -> None:
        pass


def job_states(stream: DataFrame) -> DataFrame:
    """stream: url, seq, http. Rows: url, attempts, status, retry_minutes, at each change."""
    return stream.groupBy("url").transformWithStateInPandas(JobStates(), "url string, attempts int, status string, retry_minutes long", "Update", "None")
