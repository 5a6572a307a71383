"""Near copies and bridges whose only id is null."""

import random

from confluo.llm import minhash

from .test_operators import bag, brute_components, got


def test_near_duplicates_null_ids(spark):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(8):  # a ~ null ~ b, a and b too far apart
        own = words(120)
        rows += [(10 * i + 1, " ".join(own[:100])), (None, " ".join(own[8:108])), (10 * i, " ".join(own[16:116]))]
    for i in range(8):  # one id and near copies without any, one of them thrice
        own = words(100)
        rows += [(100 + i, " ".join(own)), *[(None, " ".join(own[3:]))] * 3, (None, " ".join(own[:-4]))]
    own = words(100)  # no id at all; and a text alone
    rows += [(None, " ".join(own)), (None, " ".join(own[2:])), (None, " ".join(words(50))), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    have = minhash.near_duplicates(df)
    assert got(have.select("doc_id", "n_shingles", "component_id")) == bag(brute_components(rows))
    assert have.filter("component_id is not null and component_id % 10 = 1 and component_id < 100").count() == 0
