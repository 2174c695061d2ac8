import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kotonami.llm import terms


def brute(data):
    occ, recs, every = defaultdict(set), defaultdict(set), set()
    for term, rec, i, w in set(data):
        every.add(rec)
        if term is not None and term.strip() and rec is not None:
            occ[term].add((rec, i, w))
            recs[term].add(rec)
    every.discard(None)
    out = {}
    for t in occ:
        o, n = sum(w or 0 for _, _, w in occ[t]), len(recs[t])
        out[t] = (o, n, "common" if n * 5 > len(every) else "rare" if n < 3 or o < 5 else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    random.seed(seed)
    data = [(random.choice(["a", "b", "c", "　", "", None, " x", f"t{random.randint(0, 60)}"]), random.choice([None, *range(40)]), random.randint(0, 6), 2) for _ in range(1500)]
    data += data[:200] + [("hot", 7, i, 2) for i in range(800)]
    df = spark.createDataFrame(data, "term STRING, rec INT, i INT, n_records INT")  # a clashing name
    got = {r["term"]: (r["occurrences"], r["n_records"], r["mark"]) for r in terms.marked_terms(df, "term", "rec", ["i", "n_records"], "n_records").collect()}
    assert got == brute(data)


def test_empty_and_null_weights(spark):
    df = spark.createDataFrame([], "term STRING, rec INT, i INT, w INT")
    assert terms.marked_terms(df, "term", "rec", ["i"]).collect() == []
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 1, 2, 3), ("x" * 100_000, 1, 1, 1)], df.schema)
    got = {r["term"][:1]: r["occurrences"] for r in terms.term_counts(df, F.col("term"), F.col("rec"), [F.col("i")], F.col("w")).collect()}
    assert got == {"a": 3, "x": 1}


def test_runs_over_batches():
    rows = sorted((random.choice("ab"), random.randint(0, 5), random.randint(0, 3)) for _ in range(200))
    whole = pa.record_batch({"term": [r[0] for r in rows], "rec": [r[1] for r in rows], "o0": [r[2] for r in rows], "weight": pa.array([1] * len(rows), pa.int64())})
    for size in (1, 7, 200):
        parts = [p for b in terms.scan_runs((whole.slice(i, size) for i in range(0, len(rows), size)), ["o0"]) for p in b.to_pylist()]
        for t in "ab":
            assert sum(p["occurrences"] for p in parts if p["term"] == t) == len({r for r in rows if r[0] == t})
            assert sum(p["n_records"] for p in parts if p["term"] == t) == len({r[1] for r in rows if r[0] == t})
