"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tests and other runs in one process keep tables when the session names no shared folder.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/confluo"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a local one if all runs in
    one process, else an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/confluo/{name}-{uuid.uuid4().hex}"
    own, files = hadoop_path(spark, path)
    files.deleteOnExit(own)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Stashes that a job needs only on its way: all are removed where the `with` block ends, so what the job returns must
    not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        for path in self.paths:
            own, files = hadoop_path(self.spark, path)
            files.delete(own, True)


def small_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 4 << 20) -> None:
    """For applications: bound the Arrow batches of a session whose rows hold long texts. Operators leave the session as
    it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 300, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and about so many bytes (a row at least), whatever bounds the
    session has."""
    for x in batches:
        each = max(1, x.nbytes // max(1, x.num_rows))
        step = int(max(1, min(rows, most_bytes // each)))
        for a in range(0, x.num_rows, step):
            yield x.slice(a, step)


def hinted(df: DataFrame, n_rows: int, most: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are few; else Spark picks another join."""
    return F.broadcast(df) if n_rows <= most else df


def columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only these columns, so extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like `wanted` that `df` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def remainder_of_id(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: a split that every engine computes alike."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
