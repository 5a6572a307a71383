"""The sample that languages are learned from is bounded whatever the rows are."""

from confluo.llm import langid

SCHEMA = "doc_id long, text string, lang string, h long, place int"


def test_copies_count_once_and_bytes_are_bounded(spark):
    rows = [(1, "the same row", "en", 0, 0)] * 3000 + [(i, f"text number {i}", "en" if i % 2 else "de", 0, 0) for i in range(2, 400)] + [(None, "no id", "en", 0, 0), (401, "no language", None, 0, 0), (402, None, "en", 0, 0), (403, "x" * 5000, "de", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = langid.sampled(df, 50, 1000, "doc_id", "text", "lang").collect()
    by = {lang: [r for r in got if r.lang == lang] for lang in ("en", "de")}
    assert len(got) == sum(map(len, by.values()))
    for own in by.values():
        assert 10 < len(own) <= 50 and sum(len(r.text or "") for r in own) <= 1000 and len({(r.id, r.text) for r in own}) == len(own)
    everything = langid.sampled(df, 10_000, 1 << 20, "doc_id", "text", "lang").collect()
    assert len(everything) == len({(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[2] is not None and not held(r[0])})
    assert sorted(got, key=str) == sorted(langid.sampled(df.repartition(7), 50, 1000, "doc_id", "text", "lang").collect(), key=str)


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0
