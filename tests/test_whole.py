"""Queries over the whole of their tables: rows that the queries cut for SQL leave out."""

from datetime import datetime
from pathlib import Path

import duckdb

from confluo.plans import catalogue

from .oracle import difference


def tables(spark, path, **made):
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def against_sql(spark, d, name):
    """The rows of a query, after they were found equal to those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    df = catalogue.queries()[name](spark, d)
    assert difference(df, con, catalogue.oracle_sql()[name]) == ""
    return sorted(tuple(r) for r in df.collect())


def test_containment_whole(spark, tmp_path):
    long = "a first sentence that is a good deal longer than sixty characters, all in all"
    items = [(1, f"{long}. more"), (2, "A short one here. x"), (3, "Destiny. x"), (4, "two words. x"), (5, "no stop")]
    docs = [(1, f"{'pad ' * 900}Here: {long}. End", "en", 4000), (2, "SO A SHORT ONE HERE, said", "de", 30), (3, "undestinyed", None, 11), (4, "stwo wordsmith", "fr", 14), (5, "two  words", "en", 10), (6, f"{long} a short one here", "en", 99), (7, None, None, 0)]
    d = tables(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string, lang string, n_chars long"))
    assert against_sql(spark, d, "containment_match") == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 1)]


def test_publish_guard_whole(spark, tmp_path):
    lines = [(1, 1, 399, "A", "O", 45.0), (2, 1, 400, "A", "O", 45.0), (3, 1, 19999, "R", "F", 30.0), (4, 1, 19999, "A", "O", 8.0), (4, 2, 19999, "N", "F", 15.0)]
    d = tables(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double"))
    found = against_sql(spark, d, "publish_guard")
    assert {("event_ids_changed", "1"), ("event_ids_changed", "2"), ("single_offer_promoted_to_event_sold_out", "3"), ("detail_url_downgraded", "41"), ("valid_offer_removed_without_evidence", "41"), ("unverified_fields_became_known", "42")} == set(found)


def test_bigram_whole(spark, tmp_path):
    parts = [(1, "small ring", "b", 11), (2, "small rings", "b", 50), (3, "Small-Ring", "b", 3), (4, "small ring", "c", 11), (5, "zzz", "b", 11), (6, "", "b", 11), (7, "", "b", 12), (8, None, "b", 1), (9, "small ring", None, 1), (10, "small bolt", "b", 20)]
    parts += [(100 + i, f"{'abcde'[i % 5]}{'fghij'[i // 5]}klm{'nop'[i % 3]}", "d", i) for i in range(25)]
    d = tables(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_brand string, p_size int"))
    found = against_sql(spark, d, "bigram_similarity")
    assert {(1, 2), (1, 3), (2, 3)} <= {x[:2] for x in found} and not {x for x in found if {4, 5, 6, 7, 8, 9} & set(x[:2])}


def test_thresholds_whole(spark, tmp_path):
    day = lambda y, m: datetime(y, m, 1)
    orders = [(20, 10.0, day(1997, 1)), (21, 20.0, day(1998, 8)), (22, 30.0, day(1999, 1)), (23, 40.0, day(1998, 6)), (24, 460000.0, day(2001, 7))]
    lines = [(20, 1, 1, 7, "N", "O", 1.0, 5.0), (20, 1, 1, 7, "A", "F", 1.0, 5.0), (21, 1, 1, 7, "N", "O", 50.0, 9.0), (22, 2, 2, 7, "N", "O", 3.0, 4.0), (23, 1, 2, 7, "N", "F", 3.0, 1.0), (24, 1, 3, 8, "R", "O", 49.0, 2.0)]
    parts = [(1, "b1"), (2, "b2"), (3, "b3")]
    d = tables(spark, tmp_path, orders=(orders, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz"), part=(parts, "p_partkey long, p_brand string"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double"))
    assert against_sql(spark, d, "observation_conflicts") == [(2001, 1, "N", "A", True), (2101, 1, "N", "A", True), (2202, 2, "N", "N", False)]
    assert against_sql(spark, d, "event_context") == [(20, "b1,b1"), (21, "b1"), (22, "b2"), (23, "b2"), (24, "b3")]
    assert against_sql(spark, d, "related_top4") == [(20, 21, 1), (20, 22, 2)]
    assert against_sql(spark, d, "price_order_topk") == [(21, "1998-08-01", 9.0), (22, "1999-01-01", 4.0), (24, "2001-07-01", None)]
