import random

from kotonami.llm import leakage


def passage(n, alphabet="やがて高い紙花山川雨音金銀abc12"):
    return "".join(random.choices(alphabet, k=n))


def brute(texts, items):
    found = set()
    for d, t in texts:
        plain = leakage.letters(t)
        own = {plain[p : p + 30] for p in range(len(plain) - 29)}
        for i, s in items:
            z = leakage.letters(s)
            if any(z[p : p + 30] in own for p in range(len(z) - 29)):
                found.add((d, i))
    return found


def noisy(t):
    return "".join(c + random.choice(["", "", "", "、", "\n", " ", chr(0x200B), "★"]) for c in t)


def test_against_brute_force(spark):
    random.seed(6)
    items = [(i, passage(random.randint(20, 150))) for i in range(25)] + [(90, "高い紙" * 30), (91, None), (92, "")]
    texts = []
    for d in range(300):
        t = passage(random.randint(0, 900))
        if random.random() < 0.5:
            s = random.choice(items[:26])[1]
            a = random.randint(0, len(s))
            piece = s[a : a + random.choice([29, 30, 31, 60])]
            t = t[:300] + noisy(piece) + t[300:]
        texts.append((d, t))
    texts += [(900, None), (901, ""), (902, "高い紙" * 20_000), (902, "高い紙" * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    ev = spark.createDataFrame(items, "item_id BIGINT, surface STRING")
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs, "doc_id", "text", ev, "item_id", "surface").collect()]
    want = brute([x for x in texts if x[1]], [x for x in items if x[1]])
    assert len(got) == len(set(got)) and set(got) == want and (902, 90) in want


def test_tables_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_GRAMS", 0)
    test_against_brute_force(spark)
    random.seed(7)
    items = [(i, passage(60)) for i in range(20)]
    docs = spark.createDataFrame([(i, "前" + s) for i, s in items], "doc_id BIGINT, text STRING")
    ev = spark.createDataFrame([*items, (3, items[4][1])], "item_id INT, surface STRING")
    assert {(r[0], r[1]) for r in leakage.leaked_items(docs, "doc_id", "text", ev, "item_id", "surface").collect()} == {(i, i) for i, _ in items} | {(4, 3)}
    for bound in (0, 300_000):
        monkeypatch.setattr(leakage, "BROADCAST_GRAMS", bound)
        assert leakage.leaked_items(docs.limit(0), "doc_id", "text", ev, "item_id", "surface").collect() == []
        assert leakage.leaked_items(docs, "doc_id", "text", ev.limit(0), "item_id", "surface").collect() == []


def test_many_items_in_one_scan(spark, tmp_path):
    """5,000 items that share their beginnings: the texts are read once, and the result is that of brute force."""
    random.seed(9)
    stock = [passage(25) for _ in range(40)]
    items = [(2**60 + i, random.choice(stock) + passage(40) + random.choice(stock)) for i in range(5_000)]
    texts = []
    for d in range(400):
        t = passage(300) + random.choice(stock) * 2
        if d % 3 == 0:
            s = random.choice(items)[1]
            a = random.randint(0, 40)
            t += noisy(s[a : a + random.choice([29, 30, 45])]) + passage(50)
        texts.append((d, t))
    texts += [(None, "高い紙" * 50 + items[7][1])]
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").mapInArrow(count, "doc_id BIGINT, text STRING")
    ev = spark.createDataFrame(items, "item_id BIGINT, surface STRING")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs, "doc_id", "text", ev, "item_id", "surface").collect()}
    runs = {}
    for i, s in items:
        z = leakage.letters(s)
        for p in range(len(z) - 29):
            runs.setdefault(z[p : p + 30], set()).add(i)
    want = {(d, i) for d, t in texts for z in [leakage.letters(t)] for p in range(len(z) - 29) for i in runs.get(z[p : p + 30], ())}
    assert got == want and len(want) > 80 and (None, 2**60 + 7) in got and reads.value == len(texts)


def test_width_case_and_marks():
    assert leakage.letters("Ａb-Ｃ ｶﾞ" + "か" + chr(0x3099) + chr(0x200B) + "。「①」_é") == "abcガが1é"
