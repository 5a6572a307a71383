"""Keyed state of queue jobs, which expires."""

import pytest


def test_job_states(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark's protocol for such state
    from confluo.streaming import state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src, schema, seen = f"file://{tmp_path}/in", "url string, seq int, http int", {}
        for part in ([("a", 1, 500), ("b", 1, 200)], [("a", 3, 403), ("a", 2, 503)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            out = state.job_states(spark.readStream.schema(schema).parquet(src))
            query = out.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.update({r["url"]: tuple(r)[1:] for r in df.collect()})).option("checkpointLocation", f"file://{tmp_path}/c")
            query.trigger(availableNow=True).start().awaitTermination()
        assert seen == {"a": (3, "blocked", None), "b": (1, "done", None)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
