import itertools
import random

from conftest import rows

from kotonami.operators import lattice
from kotonami.operators.decode import Sentence, best_text
from kotonami.operators.training import learn, parse_annotated
from kotonami.plans.engine import Engine


def test_forward_costs_against_all_paths():
    random.seed(5)
    for _ in range(200):
        n = random.randint(1, 5)
        spans = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if b == a + 1 or random.random() < 0.5]
        nodes = [(-1, 0, "^", "^", 0.0)] + [(a, b, f"s{a}{b}{k}", "x" * (b - a), random.randint(1, 9) * 1.0) for a, b in spans for k in range(random.randint(1, 2))] + [(n, n + 1, "$", "$", 0.0)]
        edges = {(i, j): random.randint(0, 5) * 1.0 for i, j in itertools.permutations(range(len(nodes)), 2) if random.random() < 0.3}
        s = Sentence(nodes, edges, 3.0)

        def paths(i, cost):
            if i == len(nodes) - 1:
                yield cost
            for j in range(len(nodes)):
                if nodes[j][0] == nodes[i][1]:
                    yield from paths(j, cost + s.edge(i, j) + nodes[j][4])

        assert s.forward[s.eos] == min(paths(0, 0.0))
        cost, at = 0.0, 0
        for j in [*s.path(), len(nodes) - 1]:
            cost, at = cost + s.edge(at, j) + nodes[j][4], j
        assert cost == s.forward[s.eos]


def dictionary(spark, entries):
    return spark.createDataFrame(list(entries.items()), "yomi STRING, surfaces ARRAY<STRING>")


def engine(spark, entries, **more):
    other = spark.createDataFrame([("x/x", 0, 100)], "word STRING, word_id INT, cnt BIGINT")
    return Engine(other, spark.createDataFrame([(0, 0, 100)], "id1 INT, id2 INT, cnt BIGINT"), dictionary(spark, entries), **more)


def test_segments(spark):
    def segs(keys, text, ranges=None):
        df = spark.createDataFrame([(1, text, ranges)], "sent_id BIGINT, yomi STRING, force_ranges ARRAY<STRUCT<start: INT, end: INT>>")
        return [(e, y) for _, s, e, y in rows(lattice.segments(df, spark.createDataFrame([(k,) for k in keys], "yomi STRING")))]

    assert sorted(segs(["わたし", "わた", "し"], "わたし")) == [(2, "わた"), (3, "し"), (3, "わたし")]
    assert segs([], "わたし") == [(1, "わ"), (2, "た"), (3, "し")]
    assert segs([], "365") == [(3, "365")]
    assert sorted(segs(["わたし", "わた", "わ", "し"], "わたし", [(1, 3)])) == [(1, "わ"), (3, "たし")]
    assert segs(["わ"], "") == []


def test_nodes(spark):
    def surfaces(entries, text, **more):
        df = spark.createDataFrame([(1, text)], "sent_id BIGINT, yomi STRING")
        keys = spark.createDataFrame([(k,) for k in [*entries, text]], "yomi STRING")
        node = lattice.nodes(lattice.segments(df, keys), dictionary(spark, entries), **more)
        return [r["surface"] for r in node.orderBy("node_idx").collect() if not r["surface"].startswith("__")]

    assert surfaces({}, "す") == ["す", "ス"]
    assert surfaces({"す": ["す", "ス"]}, "す") == ["す", "ス"]
    assert surfaces({}, "すし", single=dictionary(spark, {"すし": ["🍣"]})) == ["すし", "スシ", "🍣"]
    assert surfaces({"す": ["酢"]}, "す", user=dictionary(spark, {"す": ["酢", "巣"]})) == ["酢", "巣", "す", "ス"]
    assert surfaces({}, "36") == ["36", "36", "(*(*(NUMBER-KANSUJI"]


def test_conversion_prefers_the_users_words(spark):
    own = spark.createDataFrame([("私/わたし", 1)], "key STRING, cnt BIGINT")
    assert engine(spark, {"わたし": ["渡し", "私"]}, user_unigram=own).check("わたし") == "私"
    own = spark.createDataFrame([("来た/きた", 1)], "key STRING, cnt BIGINT")
    e = engine(spark, {"きたかな": ["北香那"], "き": ["気"], "たかな": ["高菜"], "かな": ["かな"], "きた": ["来た", "北"]}, user_unigram=own)
    got = e.convert(spark.createDataFrame([(1, "きたかな")], "sent_id BIGINT, yomi STRING"))
    assert "来たかな" in [r["surface"] for r in got.where("clause_i = 0").collect()]


def test_training_corrects(spark):
    e = engine(spark, {"わたし": ["渡し", "私"], "の": ["野", "の"]})
    teacher = parse_annotated(spark.createDataFrame([(1, "私/わたし の/の")], "sent_id BIGINT, line STRING"))
    assert e.check("わたしの") != "私/の"
    better = learn(e, [(teacher, 6)])
    assert best_text(better.convert(spark.createDataFrame([(1, "わたしの")], "sent_id BIGINT, yomi STRING"))).first()["surface"] == "私の"


def test_forced_ranges_and_empty_input(spark):
    e = engine(spark, {"わたし": ["私"]})
    df = spark.createDataFrame([(1, "わたし", [(0, 1)]), (2, "", None), (3, None, None)], "sent_id BIGINT, yomi STRING, force_ranges ARRAY<STRUCT<start: INT, end: INT>>")
    got = e.convert(df).where("rank = 1")
    assert {r["sent_id"] for r in got.collect()} == {1}
    assert got.count() == 3  # わ, た, し
