import os

import pytest
from conftest import rows

from kotonami.functions.romaji import Romaji, default_table, extended
from kotonami.operators.costs import totals, with_costs
from kotonami.sources import readers, sinks


def test_default_romaji_table():
    table = default_table()
    assert len(table) > 290 and table["kkya"] == "っきゃ" and table["xtsu"] == "っ" and table["ssho"] == "っしょ" and table["zzye"] == "っじぇ"
    child = Romaji(extended(table, {"zya": None, "tso": "つぉ", "dn": "だん"}))
    assert (child.to_hiragana("zya"), child.to_hiragana("tso"), child.to_hiragana("dn")) == ("zや", "つぉ", "だん")


def test_table_files(spark, tmp_path):
    (tmp_path / "base.yml").write_text('---\nmapping:\n  "a": "あ"\n  "[": "「"\n  k: か\n', encoding="utf-8")
    (tmp_path / "child.yml").write_text("extends: base\nmapping:\n  a: null\n  b: び\n", encoding="utf-8")
    assert readers.load_table(spark, str(tmp_path / "child.yml")) == {"[": "「", "k": "か", "b": "び"}


def test_costs(spark):
    df = spark.createDataFrame([("私/わたし", 3), ("彼/かれ", 42)], "word STRING, cnt BIGINT")
    stats = totals(df)
    got = {r["word"]: r["cost"] for r in with_costs(df, stats).collect()}
    assert abs(got["私/わたし"] - 1.1949753) < 1e-6 and abs(got["彼/かれ"] - 0.048848562) < 1e-6
    assert abs(stats.first()["default_edge_cost"] - 6.672098) < 1e-6


def test_charsets_and_dictionaries(spark, tmp_path):
    (tmp_path / "a").write_bytes(";; okuri-ari entries.\nいu /言/\n;; okuri-nasi entries.\nご /語/\n".encode("euc_jp"))
    (tmp_path / "b").write_bytes("ご /語/碁/\n".encode())
    configs = [{"path": str(tmp_path / "a"), "encoding": "EucJp", "dict_type": " skk ", "usage": "Normal"}, {"path": str(tmp_path / "b"), "encoding": None, "dict_type": None, "usage": "normal "}, {"path": str(tmp_path / "none"), "usage": "Normal"}, {"path": str(tmp_path / "a"), "encoding": "EucJp", "usage": None}, {"path": str(tmp_path / "b"), "usage": "Disabled"}]
    assert rows(readers.read_dictionaries(spark, configs)) == [("いう", ["言う"]), ("ご", ["語", "碁"])]
    cache = str(tmp_path / "cache")
    readers.cached_dictionary(spark, cache, configs)
    (tmp_path / "b").write_bytes("えび /海老/\n".encode())
    os.utime(tmp_path / "b", (1, 1))
    assert ("えび", ["海老"]) in rows(readers.cached_dictionary(spark, cache, configs))
    with pytest.raises(ValueError):
        readers.charset("koi8")


def test_corpora(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.txt").write_bytes(("題\n" + "-" * 20 + "\n注\n" + "-" * 20 + "\n　小《ちひ》さな［＃注］花\r\n底本：x\n後").encode("cp932"))
    (tmp_path / "n" / "old.txt").write_bytes("ゐる".encode("cp932"))
    assert [r["line"] for r in readers.read_corpus(spark, "aozora_bunko", str(tmp_path / "n")).collect()] == ["小さな花"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "wiki_00").write_text("<doc>\n私（わたし）は\nABC\n&lt;x\n（よみ）\n", encoding="utf-8")
    assert [r["line"] for r in readers.read_corpus(spark, "jawiki", str(tmp_path / "w")).collect()] == ["私は"]
    assert readers.list_files(spark, str(tmp_path / "n")).count() == 2
    with pytest.raises(ValueError):
        readers.read_corpus(spark, "other", "x")


def test_sinks(spark, tmp_path):
    wf = spark.createDataFrame([("b/b", 2), ("a/a", 17)], "word STRING, cnt BIGINT")
    sinks.write_wfreq(wf, str(tmp_path / "wf"))
    assert rows(sinks.read_wfreq(spark, str(tmp_path / "wf"), 16)) == [("a/a", 17)]
    sinks.write_skk(spark.createDataFrame([("い", ["胃", "井"]), ("あ", ["亜"])], "yomi STRING, surfaces ARRAY<STRING>"), str(tmp_path / "skk"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "skk")).collect()] == [";; okuri-ari entries.", ";; okuri-nasi entries.", "あ /亜/", "い /胃/井/"]
    sinks.write_model(str(tmp_path / "m"), wf, wf, totals(wf))
    assert sinks.read_model(spark, str(tmp_path / "m"))[2].first()["total_words"] == 19


def test_skk_source(spark, tmp_path):
    from kotonami.operators.dictionary import parse_lines
    from kotonami.sources.skk_source import SkkSource

    (tmp_path / "a").write_bytes(";; okuri-nasi entries.\r\nご /語/\n".encode("euc_jp"))
    spark.dataSource.register(SkkSource)
    lines = spark.read.format("skk").option("encoding", "euc_jp").load(str(tmp_path / "a"))
    assert rows(parse_lines(lines).select("section", "yomi", "surfaces")) == [("nasi", "ご", ["語"])]


def test_longest_match(spark):
    from kotonami.operators.tokenize import TOKENIZERS

    texts = spark.createDataFrame([(1, "東京都に"), (2, ""), (3, None), (4, "xy")], "sent_id INT, text STRING")
    words = spark.createDataFrame([("東", "ひがし"), ("東京", "とうきょう"), ("京都", "きょうと"), ("に", "に")], "surface STRING, yomi STRING")
    assert rows(TOKENIZERS["longest_match"](texts, words)) == [(1, 0, "東京", "とうきょう"), (1, 1, "都", "都"), (1, 2, "に", "に"), (4, 0, "x", "x"), (4, 1, "y", "y")]


def test_model_checks(spark):
    from kotonami.operators.counts import costs_of, missing_pairs, numbered
    from kotonami.operators.dictionary import missing_keys

    vocab = spark.createDataFrame([("a/a", 0, 3), ("b/b", 1, 4)], "word STRING, word_id INT, cnt BIGINT")
    pairs = spark.createDataFrame([(0, 1, 2)], "id1 INT, id2 INT, cnt BIGINT")
    assert rows(missing_pairs(pairs, vocab, [("a/a", "b/b"), ("b/b", "a/a"), ("a/a", "c/c")])) == [("a/a", "c/c"), ("b/b", "a/a")]
    got = costs_of(spark.createDataFrame([("a/a",), ("z/z",)], "word STRING"), with_costs(vocab, totals(vocab)), ["word"])
    assert [(r["word"], r["cnt"]) for r in got.orderBy("word").collect()] == [("a/a", 3), ("z/z", None)]
    assert rows(missing_keys(spark.createDataFrame([("い", ["胃"])], "yomi STRING, surfaces ARRAY<STRING>"), ["い", "ろ"])) == [("ろ",)]
    with pytest.raises(Exception, match="vocabulary too large"):
        numbered(vocab.select("word", "cnt"), limit=1).collect()
