import random

from conftest import rows

from kotonami.operators.packed import PackedTokenizer, unpack

split = PackedTokenizer()


def test_separators_blanks_and_quotes():
    assert split("/a/b/") == ["a", "b"]
    assert split("a，b、c;d｜e\tf") == list("abcdef")
    assert split(" a　/　 b c ") == ["a", "b c"]
    assert split("a,,b, ,c") == ["a", "b", "c"]
    assert split("\"x,y\"|'p;q'") == ["x,y", "p;q"]
    assert split('"x/y""z"""/w') == ['x/y"z"', "w"]
    assert split("rock'n'roll/C#/a+b/3.5型/リ・ム/K-net") == ["rock'n'roll", "C#", "a+b", "3.5型", "リ・ム", "K-net"]


def test_brackets():
    assert split("['a','b,c','d']") == ["a", "b,c", "d"]
    assert split("[a][b]") == ["a", "b"]
    assert split("f(a,b),c") == ["f(a,b)", "c"]


def test_unclosed_marks_are_ordinary():
    assert split('"a,b') == ['"a', "b"]
    assert split("a(b,c") == ["a(b", "c"]
    assert split("'") == ["'"]


def test_empty_and_long():
    assert split(None) == split("") == split(" / ,, ") == split('""') == []
    assert len(split("ab/" * 200_000)) == 200_000
    assert split('"' * 100_001 + "/a")[-1] == "a"


def test_round_trip_of_quoted_values():
    random.seed(1)
    for _ in range(300):
        values = ["".join(random.choices("ab,/;'\" |漢", k=random.randint(1, 8))).strip() for _ in range(random.randint(1, 5))]
        values = [v for v in values if v]
        packed = random.choice(",/;|").join('"' + v.replace('"', '""') + '"' for v in values)
        assert split(packed) == values


def test_unpack_cases(spark):
    data = [(1, "a/b/a", 9), (1, "a/b/a", 9), (2, None, 9), (3, "", 9), (4, "x", 9), (5, "p/q", 8), (5, "r/s", 8), (None, "m/n", 7)]
    df = spark.createDataFrame(data, "entry_id BIGINT, surfaces STRING, pos INT")  # a clashing name
    assert rows(unpack(df, "surfaces", ["entry_id"], least=2)) == sorted([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (5, 1, "p"), (5, 2, "q"), (5, 1, "r"), (5, 2, "s"), (None, 1, "m"), (None, 2, "n")], key=str)
    assert rows(unpack(df.limit(0), "surfaces", ["entry_id"])) == []


def test_escapes():
    cut = PackedTokenizer(escape="\\")
    assert cut("a\\,b,c") == ["a,b", "c"]
    assert cut('"a\\"b",\\"c') == ['a"b', '"c']
    assert cut("\\[a,b]\\") == ["[a", "b]\\"]
    assert cut('"ab\\') == ['"ab\\']
    assert PackedTokenizer()("a\\,b") == ["a", "b"]


def test_one_tokenizer_and_one_shuffle(spark):
    df = spark.createDataFrame([(1, "a,b"), (1, "a,b"), (1, "a,c"), (2, "x"), (3, None), (4, "")], "entry_id INT, surfaces STRING")
    got = unpack(df, "surfaces", ["entry_id"], least=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1
    assert rows(got) == [(1, 1, "a"), (1, 2, "b"), (1, 2, "c")]
