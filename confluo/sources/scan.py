"""Scans of many sources that fail one by one.

Pages of all sources are parsed where they lie, in any task: a source with many pages is no task of its own. A page that its
parser cannot read becomes a row that says so; it fails its source, whose records are then left out, and no other. Each source
gets one row of results, and only if no source at all is read the scan is refused, so that nothing is published from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import written

#: A parser takes a page's body and url and gives records as dicts.
Parser = Callable[[str | None, str | None], Iterable[Mapping]]
PAGE = ("source_id", "page", "url", "parser_id", "body")
FAILED, SKIPPED, OK = "failed", "skipped", "ok"


def parsed_pages(pages: DataFrame, parsers: Mapping[str, Parser], record: str) -> DataFrame:
    """source_id, page, url, parser_id, n, error, and `record` (a struct of the schema `record`): a row for each record, and one
    with n = -1 for each page, with the page's error if there was one and the number of records in `count`."""
    ids = {c: pages.schema[c].dataType.simpleString() for c in PAGE}
    schema = f"source_id {ids['source_id']}, page {ids['page']}, url string, parser_id string, n int, count long, error string, record struct<{record}>"
    names = [c.strip().split(" ")[0] for c in split_fields(record)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for source, page, url, parser, body in zip(*(x.column(c).to_pylist() for c in PAGE), strict=True):
                found, error = [], None
                try:
                    if parser not in parsers:
                        raise LookupError(f"no parser {parser}")
                    found = [{k: r.get(k) for k in names} for r in parsers[parser](body, url)]
                    pa.array(found, kind)  # a record of another shape fails its page, not the task
                except Exception as e:  # whatever a parser raises is the page's error
                    found, error = [], f"{type(e).__name__}: {e}"
                out += [(source, page, url, parser, n, None, None, r) for n, r in enumerate(found)]
                out.append((source, page, url, parser, -1, len(found), error, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    arrow = arrow_schema(pages.sparkSession, schema)
    kind = arrow.field("record").type
    own = pages.select(*[F.col(c).cast("string").alias(c) if c in ("url", "parser_id", "body") else F.col(c) for c in PAGE])
    return own.mapInArrow(run, schema)


def split_fields(schema: str) -> list[str]:
    """The fields of a schema string, commas within brackets aside."""
    out, deep = [""], 0
    for c in schema:
        deep += (c in "<(") - (c in ">)")
        if c == "," and not deep:
            out.append("")
        else:
            out[-1] += c
    return [x for x in out if x.strip()]


def arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def scan(sources: DataFrame, pages: DataFrame, parsers: Mapping[str, Parser], record: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, results, parser results) of stored pages.

    sources: seq, source_id, name, skipped (a reason, or null). pages: source_id, page (its place among the source's), url,
    parser_id, body. records: source_id, page, url, n and the record's fields, of sources that are read whole. results: seq,
    source_id, name, status (ok, skipped, failed), record_count, reason, error (of the first page that failed): one for each
    source, by seq. Pages of sources that are skipped or not listed are not parsed. A source without pages is ok, with no
    records. parser results: a row for each page.
    """
    taken = pages.join(sources.filter("skipped is null").select("source_id"), "source_id", "left_semi")
    rows = written(parsed_pages(taken, parsers, record), "scan")
    told = rows.filter("n = -1")
    per = told.groupBy("source_id").agg(F.sum("count").alias("records"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"))
    status = F.when(F.col("skipped").isNotNull(), SKIPPED).when(F.col("error").isNotNull(), FAILED).otherwise(OK)
    counted = F.when(status == OK, F.coalesce("records", F.lit(0))).otherwise(F.lit(0)).cast("long")
    results = sources.join(per, "source_id", "left").select("seq", "source_id", "name", status.alias("status"), counted.alias("record_count"), F.col("skipped").alias("reason"), "error")
    whole = per.filter("error is null").select("source_id")
    records = rows.filter("n >= 0").join(whole, "source_id", "left_semi").select("source_id", "page", "url", "n", "record.*")
    pages_told = told.select("source_id", "page", "url", "parser_id", F.when(F.col("error").isNull(), "success").otherwise("parser_failed").alias("status"), "error", F.col("count").alias("output_count"))
    return records, results, pages_told


def refuse_if_all_failed(results: DataFrame) -> DataFrame:
    """The results, if a source at least was read."""
    if not results.filter(F.col("status") == OK).limit(1).count():
        raise ValueError("no source could be read; what was published before stays")
    return results
