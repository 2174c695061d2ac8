"""Queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest
import goldens
from conftest import rows

import __spark_entry__ as entry
from kotonami.plans import reference_queries

DATA = os.environ.get("KOTONAMI_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(goldens.QUERIES))
def test_golden(spark, name):
    df = goldens.QUERIES[name](spark, "")
    want = duckdb.connect().execute(goldens.SQL[name])
    order = [d[0] for d in want.description]
    expected = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()]
    assert rows(df.select(*order)) == sorted(expected, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["token_merge", "bigram_model", "new_words", "dictionary_merged", "dictionary_okuri", "eval_nodes", "lattice_edges", "lattice_decoded", "lattice_best", "eval_converted", "system_dictionary", "learned_bigrams", "typed_kana", "clauses_moved", "width_forms", "annotated_words", "p3_found", "p3_loaded"])
def test_tables(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert rows(df.select(*order)) == sorted(map(tuple, want.fetchall()), key=str)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(reference_queries.SQL) <= set(reference_queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_conversion_is_right_and_clean(spark):
    """Converted sentences hold no character that the corpus lacks, but for what was in their readings; and a floor of accuracy."""
    got = entry.queries()["eval_converted"](spark, DATA).collect()
    tokens = spark.read.parquet(f"{DATA}/intermediate_token.parquet").select("surface").distinct().collect()
    kana = "".join(chr(c) for c in range(0x3041, 0x3100)) + "0123456789。、ー"
    known = {ch for (t,) in tokens if t for ch in t} | set(kana)
    readings = {ch for r in spark.read.parquet(f"{DATA}/eval_item.parquet").select("yomi").collect() for ch in r[0] or ""}
    assert got and {ch for r in got for ch in r["surface"]} <= known | readings
    score = entry.queries()["eval_scores"](spark, DATA).first()
    assert score["good"] + score["bad"] == len(got) and score["recall"] > 40
