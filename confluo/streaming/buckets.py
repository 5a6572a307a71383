"""Upserts into a table of buckets: a batch rewrites the buckets that its keys fall into, and no other.

A bucket's rows lie in a folder of the batch that wrote them last. A manifest a batch says which folder is each bucket's; it is
written last, so readers see a batch whole or not at all. A batch that runs again starts from the manifest before its own, so
it writes the same rows over what it wrote, and a key is never counted twice. Folders that the last manifests no longer name are
removed.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from confluo.operators import ranking
from confluo.sources.folders import exists, file_system


class Buckets:
    """The latest row of each key by `at` (ties: the smallest `tie`)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str], at: str, tie: str, buckets: int = 64, keep: int = 3):
        self.spark, self.folder, self.keys, self.at, self.tie, self.buckets, self.keep = spark, folder.rstrip("/"), keys, at, tie, buckets, keep
        self.schema = spark.createDataFrame([], schema).schema

    def _numbers(self) -> list[int]:
        own, files = file_system(self.spark, f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in files.listStatus(own)] if files.exists(own) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, number: int) -> dict[int, int]:
        """Bucket to the batch that wrote it last, as of a batch."""
        own, files = file_system(self.spark, f"{self.folder}/manifests/{number}")
        stream = files.open(own)
        try:
            return {int(b): v for b, v in json.loads(bytes(stream.readAllBytes())).items()}
        finally:
            stream.close()

    def _put(self, number: int, found: dict[int, int]) -> None:
        own, files = file_system(self.spark, f"{self.folder}/manifests/{number}")
        stream = files.create(own, True)
        try:
            stream.write(bytearray(json.dumps(found).encode()))
        finally:
            stream.close()

    def _paths(self, found: dict[int, int]) -> list[str]:
        return [f"{self.folder}/data/batch={v}/bucket={b}" for b, v in sorted(found.items())]

    def _rows(self, found: dict[int, int]) -> DataFrame:
        paths = self._paths(found)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the last batch."""
        numbers = self._numbers()
        return self._rows(self.manifest(numbers[-1]) if numbers else {})

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; numbers rise, and one that is given again is done again from the batch before it."""
        before = [n for n in self._numbers() if n < number]
        old = self.manifest(before[-1]) if before else {}
        of = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = ranking.latest(batch.select(*self.schema.names), self.keys, self.at, self.tie).select(*self.schema.names)
        touched = sorted(r.b for r in new.select(of.alias("b")).distinct().collect())  # `buckets` numbers at most
        if touched:
            rows = self._rows({b: old[b] for b in touched if b in old}).unionByName(new)
            merged = ranking.latest(rows, self.keys, self.at, self.tie).select(*self.schema.names).withColumn("bucket", of)
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={number}")
        self._put(number, old | dict.fromkeys(touched, number))
        self._expire()

    def _expire(self) -> None:
        numbers = self._numbers()
        kept, gone = numbers[-self.keep :], numbers[: -self.keep]
        named = {path for n in kept for path in self._paths(self.manifest(n))}
        for n in gone:
            for path in set(self._paths(self.manifest(n))) - named:
                if exists(self.spark, path):
                    own, files = file_system(self.spark, path)
                    files.delete(own, True)
            own, files = file_system(self.spark, f"{self.folder}/manifests/{n}")
            files.delete(own, False)


def upsert_stream(stream: DataFrame, table: Buckets, checkpoint: str):
    """A writer that upserts each batch; start() it."""
    return stream.writeStream.foreachBatch(partial(lambda t, batch, number: t.upsert(batch, number), table)).option("checkpointLocation", checkpoint).outputMode("append")
