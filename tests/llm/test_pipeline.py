"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
from confluo.llm import gam, mixing, pii
from confluo.llm.shared import stash, table

from .test_operators import brute_components, packing_holds


def test_pipeline(spark, small):
    from confluo.llm import packing, queries

    docs = table(spark, small, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stash(stage(spark, steps[-1], small), f"test-{name}"))
    kinds = [x.dtypes for x in steps]
    assert all(k == kinds[0] for k in kinds[:5])
    rows = [[tuple(r) for r in x.collect()] for x in steps]
    model = gam.fit(docs, table(spark, small, "labels"))
    good = {r["doc_id"] for r in gam.score(docs, model).collect() if r["predicted"] == 1}
    assert {r[0] for r in rows[1]} == good and len(good) < len(rows[0])
    kept = {i for i, _, c in brute_components([(r[0], r[1]) for r in rows[1]]) if i == c}
    assert sorted(r[0] for r in rows[2]) == sorted(kept)
    before = {r[0]: r for r in rows[2]}
    assert len(rows[3]) == len(rows[2])
    for r in rows[3]:
        want = pii.redacted(before[r[0]][1])
        assert r[1] == want and r[4] == len(want) and r[2:4] == before[r[0]][2:4]
    times = {r["doc_id"]: r["repeats"] + (r["extra"] > 0) for r in mixing.mix(steps[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({k: v for k, v in times.items() if v})
    again = [tuple(r[k] for k in ("doc_id", "piece", "start", "length", "sequence_id", "offset")) for r in steps[5].collect()]
    assert sum(1 for r in again if r[1] == 0) == len(rows[4]) and len({(r[4], r[5]) for r in again}) == len(again)
    own = packing.pack(steps[3], queries.tokenizer(queries.WORDS), with_ids=True).collect()
    packing_holds([tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")) for r in own], {r[0]: r[1] for r in rows[3]}, 4096)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_odd_rows(spark, small):
    """Nulls in any column, empty texts, repeated rows: clean documents stay."""
    docs = table(spark, small, "documents").limit(40)
    odd = spark.createDataFrame([(None, "quite another text of six words", None, None, None), (None, "quite another text of six words", None, None, None), (9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "one text under an id here", "en", "s", 1), (9003, "another text under the same id", "en", "s", 1), (9003, "one text under an id here", "en", "s", 1)], docs.schema)
    found = corpus_pipeline.near_duplicates(spark, odd, small).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter({(None, "quite another text of six words"): 1, (9001, None): 1, (9002, ""): 1, (9003, "one text under an id here"): 1, (9003, "another text under the same id"): 1})
    both = stash(docs.unionByName(odd), "odd")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, both, small)
        assert kept.columns == docs.columns and kept.count() > 0
        assert stage(spark, both.limit(0), small).count() == 0
    assert corpus_pipeline.packed(spark, both, small).filter("piece = 0").count() == both.count()
