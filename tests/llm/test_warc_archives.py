"""Archives that grow, foreign and plain ones, indexes, predicates, and payloads that are not what they were."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from confluo.llm import queries, warc
from confluo.llm.shared import scratch

PAGE = "<html>" + "é page " * 50 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def local(path):
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    return path.removeprefix("file://")


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_append_and_overwrite(spark):
    path = scratch(spark, "warc-append")
    warc.archive(pages(spark, [(1, "u1", PAGE)]), path)
    warc.archive(pages(spark, [(3, "u3", PAGE + "x"), (4, None, None)]), path)
    assert set(by_id(warc.read_archive(spark, path))) == {"1", "3", "4"}
    warc.archive(pages(spark, [(9, "u9", PAGE)]), path, mode="overwrite")
    assert set(by_id(warc.read_archive(spark, path))) == {"9"}
    assert len([x for x in os.listdir(path.removeprefix("file://")) if x.endswith(".warc.gz")]) == len([x for x in os.listdir(path.removeprefix("file://")) if x.endswith(".idx")])


def test_query_with_null_ids(spark, tmp_path):
    rows = [(None, "u", PAGE), (2, "u2", PAGE), (5, "u5", PAGE), (6, None, None), (None, None, "")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    have = sorted(map(tuple, queries.op4_warc(spark, str(tmp_path)).collect()), key=str)
    digest = lambda x: (len((x or "").encode()), hashlib.sha256((x or "").encode()).hexdigest())
    want = [(None, *digest(PAGE), "response", None), (2, *digest(PAGE), "response", None), (5, *digest(PAGE), "revisit", 2), (6, *digest(None), "response", None), (None, *digest(""), "response", None)]
    assert have == sorted(want, key=str)


def foreign(kind="response", n=0, uri="http://x/a%2525b%0Ac%20d", body=b"hello"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWarc-Record-Id: <urn:uuid:{n}>\r\nWARC-TARGET-URI: {uri}\r\nX-Note: one\r\n two\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("indexed", [False, True])
@pytest.mark.parametrize("ending", [".warc", ".warc.gz"])
def test_foreign_archives(spark, ending, indexed):
    path = scratch(spark, "warc-foreign")
    own = [foreign("warcinfo" if i == 0 else "response" if i % 3 else "request", i, body=b"body %d " % i * (1 + i * 50)) for i in range(40)]
    pack = gzip.compress if ending == ".warc.gz" else bytes
    with open(f"{local(path)}/x{ending}", "wb") as f:
        f.write(b"".join(map(pack, own)))
    if indexed:
        assert warc.index_archives(spark, path) == [(f"{local(path)}/x{ending}", 40)] and warc.index_archives(spark, path) == []
    back = spark.read.format("warc").option("partitionbytes", "2000").load(path) if indexed else warc.read_archive(spark, path)
    rows = back.collect()
    assert len(rows) == 40 and {r["target_uri"] for r in rows} == {"http://x/a%2525b%0Ac%20d"}
    assert {r["record_id"]: r["payload"] for r in rows} == {f"<urn:uuid:{i}>": b"body %d " % i * (1 + i * 50) for i in range(40)}
    some = back.filter("record_type = 'request'")
    assert sorted(r["record_id"] for r in some.collect()) == sorted(f"<urn:uuid:{i}>" for i in range(3, 40, 3))
    assert (back.rdd.getNumPartitions() > 3) == (indexed and ending == ".warc") or indexed
    assert warc.read_archive(spark, path, payloads=False).filter("payload is not null").count() == 0


def test_members_that_hold_several_records_get_no_index(spark):
    path = scratch(spark, "warc-several")
    with open(f"{local(path)}/x.warc.gz", "wb") as f:
        f.write(gzip.compress(foreign(n=1) + foreign(n=2)) + gzip.compress(foreign(n=3)))
    assert [n for _, n in warc.index_archives(spark, path)] == [-1]
    assert warc.read_archive(spark, path).count() == 3


class Counting:
    """A file that counts the bytes that are read."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at, self.read_bytes = self.at + len(out), self.read_bytes + len(out)
        return out


def test_unwanted_members_are_not_read():
    import random

    import numpy as np

    noise = random.Random(1).randbytes(200_000)
    own = [gzip.compress(foreign("response" if i % 5 else "request", i, body=noise)) for i in range(20)]
    sizes = [len(x) for x in own]
    raw = Counting(b"".join(own))
    places = np.array([[sum(sizes[:i]), n] for i, n in enumerate(sizes)])
    assert [list(x) for x in warc.member_places(Counting(raw.data))] == places.tolist()
    found = [head["warc-record-id"] for head, payload in warc.member_records(raw, places, lambda head: head["warc-type"] == "request") if payload == noise]
    assert found == [f"<urn:uuid:{i}>" for i in range(0, 20, 5)]
    assert raw.read_bytes < 4 * max(sizes) + 20 * 4096


def test_corrupt_payload(spark):
    path = scratch(spark, "warc-corrupt")
    one = warc.record("response", "1", "u", hashlib.sha256(b"right").hexdigest(), 5, b"wrong", None)
    with open(f"{local(path)}/x.warc.gz", "wb") as f:
        f.write(gzip.compress(one))
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_archive(spark, path).collect()
    assert warc.read_archive(spark, path, verify=False).select("payload").first()[0] == b"wrong"


def test_odd_urls_and_ids(spark):
    path = scratch(spark, "warc-odd")
    rows = [("a b%20<é>", " http://x/ y\t", "1" * 200), ("", "http://x/a%2525b%20", "2"), ("b", "u\r\nWARC/1.1", "3"), (None, "ü", "4"), ("z", "zz", "1" * 200)]
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "page_id string, url string, html string, record_type int, payload string")
    warc.archive(df, path)
    back = by_id(warc.read_archive(spark, path))
    assert {k: r["target_uri"] for k, r in back.items()} == {k: u for k, u, _ in rows}
    assert back["z"]["refers_to"] == back["a b%20<é>"]["record_id"]
    assert warc.read_archive(spark, path).filter(F.col("target_uri") == "u\r\nWARC/1.1").count() == 1


def test_files_are_bounded(spark):
    path = scratch(spark, "warc-rolled")
    warc.register(spark)
    df = spark.range(60).coalesce(1).selectExpr("'response' record_type", "string(id) page_id", "'u' target_uri", "sha2('', 256) payload_digest", "0L payload_length", "cast('' as binary) payload", "cast(null as string) refers_to")
    df.write.format("warc").option("filebytes", "2000").mode("append").save(path)
    files = [x for x in os.listdir(path.removeprefix("file://")) if x.endswith(".warc.gz")]
    assert len(files) > 3 and warc.read_archive(spark, path).count() == 60
    assert spark.read.format("warc").option("partitionbytes", "700").load(path).select("page_id").distinct().count() == 60
