import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotonami.llm import cooccur


def brute(items, total, least, lift):
    recs = {}
    for r, i in items:
        recs.setdefault(r, set()).add(i)
    n = Counter(i for s in recs.values() for i in s)
    pairs = Counter(p for s in recs.values() for p in combinations(sorted(s), 2))
    return {(a, b, c) for (a, b), c in pairs.items() if c >= least and c * total >= lift * n[a] * n[b]}


@pytest.mark.parametrize("crowd", [400, 6])
def test_pairs_against_brute_force(spark, crowd):
    random.seed(crowd)
    items = {(r, f"i{min(random.randint(0, 25), random.randint(0, 25))}") for r in range(300) for _ in range(random.randint(1, 5))}
    items |= {(r, f"{p}{k}") for r in range(290, 300) for p in "xyz" for k in range(5)}  # crowded records with pairs of their own
    df = spark.createDataFrame(sorted(items), "rec INT, item STRING")
    total = spark.createDataFrame([(400,)], "total BIGINT")
    got = {(r["item_a"], r["item_b"], r["n_ab"]) for r in cooccur.basket_pairs(df, total, crowd=crowd).collect()}
    assert got == brute(items, 400, 5, 4)


@pytest.mark.parametrize("block", [2048, 8])
def test_crowded_records_in_chunks_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(cooccur, "WORDS", 1)  # chunks of 64 records
    monkeypatch.setattr(cooccur, "BLOCK", block)
    random.seed(3)
    items = {(r, f"i{random.randint(0, 60)}") for r in range(300) for _ in range(3)}
    items |= {(r, f"{p}{k}") for r in range(1000, 1150) for p in "xyz" if random.random() < 0.4 for k in range(12)}
    items |= {(r, f"i{random.randint(0, 60)}") for r in range(1000, 1150) for _ in range(9)}
    df = spark.createDataFrame(sorted(items), "rec INT, item STRING")
    total = spark.createDataFrame([(900,)], "total BIGINT")
    got = [(r["item_a"], r["item_b"], r["n_ab"]) for r in cooccur.basket_pairs(df, total, crowd=8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(items, 900, 5, 4) and len(got) > 500


def test_a_huge_record_and_a_frequent_item(spark):
    """A record of 50,000 items lists no pairs; an item in nearly a quarter of all records is in as many crowded ones."""
    small = {(i % 10_000, f"w{(i * 7919 + i // 7) % 6000}") for i in range(40_000)} | {(i, "hot") for i in range(2400)} | {(i, "rare") for i in range(0, 2400, 3)}
    mine = spark.createDataFrame(sorted(small), "rec INT, item STRING")
    df = mine.unionByName(spark.range(50_000).selectExpr("50000 AS rec", "concat('w', CAST(id AS STRING)) AS item"))
    got = {(r["item_a"], r["item_b"], r["n_ab"]) for r in cooccur.basket_pairs(df, spark.createDataFrame([(10_001,)], "total BIGINT"), crowd=4).collect()}
    recs, n, pairs = {}, Counter(), Counter()
    for r, i in small:
        recs.setdefault(r, set()).add(i)
        n[i] += 1
    for s in recs.values():
        pairs.update(combinations(sorted(s), 2))
    n = {i: c + i.startswith("w") for i, c in n.items()}
    want = {(a, b, c) for (a, b), k in pairs.items() if (c := k + (a[0] == b[0] == "w")) >= 5 and c * 10_001 >= 4 * n[a] * n[b]}
    assert got == want and ("hot", "rare", 800) in got


def test_surprise(spark):
    random.seed(2)
    items = {(r, f"i{random.randint(0, 30)}") for r in range(400) for _ in range(4)} | {(r, w) for r in range(0, 400, 20) for w in ("p", "q")}
    df = spark.createDataFrame(sorted(items), "rec INT, item STRING")
    pairs = cooccur.basket_pairs(df, df.select(F.count_distinct("rec").alias("total")), lift=1)
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.surprise(pairs, df).collect()}
    assert got["p", "q"]["log10_p"] < -10 and got["p", "q"]["q_value"] < 1e-6
    assert all(0 <= r["q_value"] <= 1 and r["expected"] > 0 for r in got.values())


def test_link_surprise(spark):
    """Expected counts add up to the links; a pair that many records name on top stands out, and it alone."""
    random.seed(8)
    names = [f"i{k}" for k in range(40)]
    links = {(r, *sorted(random.sample(names, 2))) for r in range(300) for _ in range(r % 7 + 1)} | {(r, "i3", "i4") for r in range(0, 300, 6)}
    df = spark.createDataFrame(sorted(links), "rec INT, item_a STRING, item_b STRING")
    items = df.select("rec", F.explode(F.array("item_a", "item_b")).alias("item")).distinct()
    pairs = cooccur.keyed_pairs(df, items, spark.createDataFrame([(300,)], "total BIGINT"), least=1, lift=0)
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.link_surprise(pairs, df).collect()}
    assert len(got) == len({p[1:] for p in links})
    assert [p for p, r in got.items() if r["surprising"]] == [("i3", "i4")] and got["i3", "i4"]["log10_p"] < -20
    rest = [r for p, r in got.items() if p != ("i3", "i4")]
    assert 0.8 < sum(r["expected"] for r in rest) / sum(r["n_ab"] for r in rest) < 1.05


def test_link_model_keeps_degrees():
    k, c, n, m = np.array([4.0, 9.0, 30.0]), np.array([20.0, 10.0, 2.0]), np.array([1.0, 3.0, 10.0]), np.array([45.0, 15.0, 2.5])
    x, y = cooccur.fit_links(k, c, n, m)
    p = (z := x[:, None, None] * x[None, :, None] * y) / (1 + z)
    other = c[None, :] - np.eye(3)
    assert np.allclose((other[:, :, None] * p * m).sum((1, 2)), k, rtol=1e-3)
    assert np.allclose((c[:, None, None] * other[:, :, None] / 2 * p).sum((0, 1)), n, rtol=1e-3)


def test_degree_classes_against_the_exact_fit(monkeypatch):
    """Thousands of distinct degrees: expected counts and tails from classes are those of the exact fit, nearly."""
    rng = np.random.default_rng(1)
    di, dr = np.round(1000 * rng.pareto(1.2, 3000) + 1), np.round(1200 * rng.pareto(2.0, 3000) + 1)
    di = np.minimum(di, 2500)
    dr = np.minimum(dr * di.sum() / dr.sum(), 2800).round()
    dr[: int(abs(di.sum() - dr.sum())) % 3000] += np.sign(di.sum() - dr.sum())

    def tails(exact, k=None):
        monkeypatch.setattr(cooccur, "EXACT_DEGREES", exact)
        parts = []
        for d in (di, dr):
            classes, inverse = np.unique(cooccur.degree_class(d), return_inverse=True)
            n = np.bincount(inverse)
            parts += [np.bincount(inverse, d) / n, n.astype(float), classes]
        x, y = cooccur.fit_configuration(parts[0], parts[1], parts[3], parts[4])
        ends = []
        for d in (np.unique(di)[::7], np.unique(di)[::7][::-1]):
            at = np.searchsorted(parts[2], cooccur.degree_class(d))
            ends.append(cooccur.fugacity(d, x[at], y, parts[4])[:, None] * y)
        q = ends[0] / (1 + ends[0]) * (ends[1] / (1 + ends[1]))
        k = np.ceil(1.2 * (q @ parts[4]) + 5) if k is None else k
        return k, *cooccur.upper_tail(k, q, parts[4])

    k, mean, logp = tails(10**9)
    _, mean_c, logp_c = tails(1024, k)
    worst = np.max(np.abs(mean_c / mean - 1)), np.max(np.abs(logp_c / logp - 1))
    print("worst", worst)
    assert worst[0] < 0.001 and worst[1] < 0.01


def test_configuration_model_keeps_degrees():
    di, ni, dr, nr = np.array([2.0, 5.0]), np.array([30.0, 8.0]), np.array([1.0, 4.0]), np.array([20.0, 20.0])
    x, y = cooccur.fit_configuration(di, ni, dr, nr)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ nr, di, rtol=1e-4) and np.allclose(ni @ p, dr, rtol=1e-4)


def test_tail_against_exact_sums():
    q, m = np.array([[0.02, 0.1, 0.3]]), np.array([60.0, 20.0, 5.0])
    pmf = np.array([1.0])
    for a, b in zip(q[0], m.astype(int)):
        for _ in range(b):
            pmf = np.convolve(pmf, [1 - a, a])
    for k in (7, 10, 15, 20):
        _, got = cooccur.upper_tail(np.array([float(k)]), q, m)
        assert abs(got[0] - np.log10(pmf[k:].sum())) < 0.05


def test_empty(spark):
    df = spark.createDataFrame([], "rec INT, item STRING")
    total = df.select(F.count_distinct("rec").alias("total"))
    assert cooccur.surprise(cooccur.basket_pairs(df, total), df).collect() == []
    links = spark.createDataFrame([], "rec INT, item_a STRING, item_b STRING")
    assert cooccur.link_surprise(cooccur.keyed_pairs(links, df, total), links).collect() == []
