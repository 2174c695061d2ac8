import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kotonami.operators.ordered import ranked, running, with_previous


@pytest.mark.parametrize("crowded", [True, False, None])
def test_windows_in_one_and_two_levels(spark, crowded):
    random.seed(3)
    data = [(g, i, random.randint(0, 9)) for g in (1, 2, None) for i in random.sample(range(400), 150)]
    df = spark.createDataFrame(data, "g INT, i INT, v INT")
    by = {}
    for g, i, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        by.setdefault(g, []).append((i, v))
    prev = {(r["g"], r["i"]): r["prev"] for r in with_previous(df, "g", "i", ["v"], crowded, chunk=16).collect()}
    sums = {(r["g"], r["i"]): (r["s"], r["m"]) for r in running(running(df, "g", "i", F.col("v"), "s", before=True, crowded=crowded, chunk=16), "g", "i", F.col("v"), "m", how="max", crowded=crowded, chunk=16).collect()}
    for g, seq in by.items():
        for k, (i, v) in enumerate(seq):
            assert (prev[g, i]["v"] if prev[g, i] else None) == (seq[k - 1][1] if k else None)
            assert sums[g, i] == (sum(x for _, x in seq[:k]), max(x for _, x in seq[: k + 1]))


def test_ranks(spark):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    got = rows(ranked(spark.createDataFrame([(w,) for w in words], "word STRING"), ["word"], "k"))
    assert got == sorted((w, k) for k, w in enumerate(sorted(words)))
    assert rows(ranked(spark.createDataFrame([], "word STRING"), ["word"], "k")) == []
