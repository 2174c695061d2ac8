from conftest import rows

from kotonami.operators.badrows import read_records


def read(spark, lines):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "line_id BIGINT, line STRING, reason STRING")
    return {r["line_id"]: r for r in read_records(df, "line", ["line_id"]).collect()}


def test_reasons(spark):
    cases = [
        ("しよう,/使用/仕様/,名詞,3", None), ('"しよう","/使用;""旧""/仕様",名詞,x', None), ("しよう,/使用/,名詞,3\r", None), ("うごk,/動/,動詞,", None),
        (";; comment,,", "skip"), ("", "skip"), ("　 ", "skip"), (None, "skip"),
        ('しよう,"/a/"b,名詞,1', "quoting"), ('"しよう,/a/,名詞,1', "quoting"), ('し"よう,/a/,名詞,1', "quoting"), (' "しよう",/a/,名詞,1', "quoting"),
        ("しよう,/a/,名詞", "columns"), ("しよう,/a/,名詞,1,", "columns"), ("しよう", "columns"),
        ("シヨウ,/a/,名詞,1", "yomi"), (",/a/,名詞,1", "yomi"), ("しよkk,/a/,名詞,1", "yomi"), ("k,/a/,名詞,1", "yomi"), ("し よ,/a/,名詞,1", "yomi"), ("しよう\n,/a/,名詞,1", "yomi"),
        ("しよう, ,名詞,1", "surfaces"), ("しよう,/;note/,名詞,1", "surfaces"), ("しよう,/　/ //,名詞,1", "surfaces"), ("しよう,/a\x07/,名詞,1", "surfaces"), ("しよう,/a" + chr(0xFFFD) + "/,名詞,1", "surfaces"), ("しよう,,名詞,1", "surfaces"),
    ]
    got = read(spark, [c for c, _ in cases])
    for i, (line, reason) in enumerate(cases):
        assert (got[i]["reason"] if i in got else "skip") == reason, line
    assert got[1]["candidates"] == ["使用", "仕様"] and got[1]["cnt"] is None
    assert (got[0]["yomi"], got[0]["candidates"], got[0]["hinshi"], got[0]["cnt"]) == ("しよう", ["使用", "仕様"], "名詞", 3)


def test_long_and_empty(spark):
    long = 'しよう,"/' + '""a/' * 100_000 + '",名詞,1'
    got = read(spark, [long, '"' * 100_001])
    assert got[0]["reason"] is None and len(got[0]["candidates"]) == 100_000 and got[1]["reason"] == "quoting"
    empty = spark.createDataFrame([], "line_id BIGINT, line STRING")
    assert rows(read_records(empty, "line", ["line_id"])) == []
