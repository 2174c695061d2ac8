"""Queries that give the whole result, on tables made for it."""

import os

import duckdb
import pytest
from conftest import rows

from kotonami.operators import dictionary
from kotonami.plans import reference_queries


def test_kansuji_of_every_bigint(spark, tmp_path):
    surfaces = ["12", "0012", "1234567890123", "100000000000000000", "9223372036854775807", "0009223372036854775807", "9223372036854775808", "1" * 30, "12\n", "-3", "一", "", None]
    spark.createDataFrame([(s,) for s in surfaces], "surface STRING").write.parquet(f"{tmp_path}/intermediate_token.parquet")
    got = dict(rows(reference_queries.kansuji_numbers(spark, str(tmp_path))))
    most = "九百二十二京三千三百七十二兆三百六十八億五千四百七十七万五千八百七"
    assert got == {"12": "十二", "0012": "十二", "1234567890123": "一兆二千三百四十五億六千七百八十九万百二十三", "100000000000000000": "十京", "9223372036854775807": most, "0009223372036854775807": most}


def test_all_continuations_of_all_prefixes(spark):
    readings = [f"かい{a}{b}" for a in "あいうえお" for b in "かきくけこ"] + ["かい", "か", "𠮷野", "", None, "かい"]
    prefixes = ["か", "かい", "かいあ", "𠮷", "", "さ", None, "か", "かいあかさたな"]
    words = spark.createDataFrame([(r,) for r in readings], "yomi STRING")
    got = rows(dictionary.continuations(words, spark.createDataFrame([(p,) for p in prefixes], "q STRING"), "q"))
    want = {(p, r) for p in prefixes for r in readings if p is not None and r is not None and r.startswith(p)}
    assert got == sorted(want, key=str)
    assert len(rows(dictionary.predictive_hits(words, "かい"))) == 26 and len(rows(dictionary.predictive_hits(words, "かい", 10))) == 10


DATA = os.environ.get("KOTONAMI_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["dictionary_predictions", "dictionary_continuations", "kansuji_numbers"])
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("dict_decoded", "word_node", "intermediate_token"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(reference_queries.SQL[name])
    order = [d[0] for d in want.description]
    got = rows(reference_queries.QUERIES[name](spark, DATA).select(*order))
    assert got and got == sorted(map(tuple, want.fetchall()), key=str)
