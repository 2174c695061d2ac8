import random

from kotonami.llm import encodings

KANJI = "山川花雨音金銀紙石村木林森火水日月年左右上下大小高低新古長"
KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノ"


def word():
    return "".join(random.choices(random.choice([KANJI, KANA]), k=random.randint(2, 4)))


def western(data):
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


GARBLE = {
    "utf-8 as western": lambda t: western(t.encode()), "utf-8 as western, twice": lambda t: western(western(t.encode()).encode()), "cp932 as western": lambda t: western(t.encode("cp932")), "euc_jp as western": lambda t: t.encode("euc_jp").decode("latin-1"),
    "euc_jp as cp932": lambda t: t.encode("euc_jp").decode("cp932", "replace"), "cp932 as utf-8": lambda t: t.encode("cp932").decode("utf-8", "replace"), "utf-8 as euc_jp": lambda t: t.encode().decode("euc_jp", "replace"),
}


def test_inverse_of_each_chain():
    random.seed(1)
    scorer = encodings.Scorer()
    for name, garble in GARBLE.items():
        hits = 0
        for _ in range(60):
            t = word()
            scores = dict(zip(encodings.CHAINS, scorer.scores(garble(t))))
            assert max(scores.values()) > scores["sound"], (name, t)
            hits += encodings.repaired(garble(t), name) == t
        assert hits == 60 or "as western" not in name


def test_sound_text_stays(spark):
    random.seed(2)
    odd = ["×", "€", "café", "São Mirel", "🍣", "ｲﾝｸ", "α", "①", "縺れ", "Über", "rock'n'mill"]
    data, bad, k = [], set(), 0
    for d in range(6):
        for _ in range(250):
            items = [word() for _ in range(random.randint(1, 4))]
            if random.random() < 0.15:
                items.append(random.choice(odd))
            if random.random() < (0.5 if d == 3 else 0.03):
                name = "cp932 as western" if d == 3 else random.choice(list(GARBLE))
                items = [GARBLE[name](i) for i in items if i not in odd] or [GARBLE[name]("山川")]
                bad.add(k)
            data.append((k, d if d else None, "/" + "/".join(items) + "/", "x"))
            k += 1
    data += [(k, 1, None, "x"), (k + 1, 1, "", "x"), data[0], (k + 2, 1, "/" + "山川/" * 20_000, "x")]
    df = spark.createDataFrame(data, "decoded_id BIGINT, dict_id INT, surfaces STRING, garbled STRING")  # a clashing name
    got = {r["decoded_id"]: r for r in encodings.repaired_records(df, "decoded_id", "dict_id", "surfaces").collect()}
    found = {i for i, r in got.items() if r["garbled"]}
    assert len(found & bad) >= 0.97 * len(bad) and len(found - bad) <= 0.01 * len(data)
    assert k not in got and k + 1 not in got and not got[k + 2]["garbled"]
    assert all(any(c in KANJI + KANA for c in got[i]["repaired"]) for i in found if got[i]["recovered"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "decoded_id BIGINT, dict_id INT, surfaces STRING")
    assert encodings.repaired_records(df, "decoded_id", "dict_id", "surfaces").collect() == []


def test_long_items_have_no_floor(spark):
    random.seed(3)
    long = lambda: "".join(random.choices(KANJI + KANA, k=300))
    scorer = encodings.Scorer()
    lossless = {"utf-8 as western", "utf-8 as western, twice", "cp932 as western", "euc_jp as western"}
    data, want = [], {}
    for k, name in enumerate(GARBLE):
        t = long()
        garbled = GARBLE[name](t)
        scores = dict(zip(encodings.CHAINS, scorer.scores(garbled)))
        assert scores["sound"] < scores[name] - 100 and (encodings.LOST in garbled or max(scores, key=scores.get) == name)
        data.append((k, k % 2, f"/山川;{garbled}/"))
        want[k] = f"/山川;{t}/" if name in lossless else None
    sound = [f"/山川;{long()}。{long()}、×①/", "/é;" + "São Mirel café. " * 40 + "/"]
    data += [(100 + k, 0, s) for k, s in enumerate(sound)] + [(200, 0, f"/山川;{long()}{encodings.LOST}/")]
    got = {r["decoded_id"]: r for r in encodings.repaired_records(spark.createDataFrame(data, "decoded_id BIGINT, dict_id INT, surfaces STRING"), "decoded_id", "dict_id", "surfaces").collect()}
    assert {k for k, r in got.items() if r["garbled"]} == {*want, 200}
    assert all(got[k]["repaired"] == text for k, text in want.items() if text) and not got[200]["recovered"]


def test_frequent_garbled_notes_are_no_known_words(spark):
    note = GARBLE["cp932 as western"](KANA[:6])
    data = [(k, k % 3, f"/山{'川花雨音'[k % 4]};{note}/") for k in range(400)]
    got = encodings.repaired_records(spark.createDataFrame(data, "decoded_id BIGINT, dict_id INT, surfaces STRING"), "decoded_id", "dict_id", "surfaces")
    assert got.where("garbled and recovered").count() == 400 and KANA[:6] in got.first()["repaired"]


def test_unrelated_rows_change_nothing(spark):
    """Records of other sources and words, a hundred times as many, leave the judgement of each record as it is."""
    random.seed(4)
    data = []
    for k in range(300):
        items = [word() for _ in range(random.randint(1, 3))]
        if k % 5 == 0:
            items = [GARBLE[random.choice(list(GARBLE))](i) for i in items]
        data.append((k, k % 3, "/" + "/".join(items) + "/"))
    own = spark.createDataFrame(data, "decoded_id BIGINT, dict_id INT, surfaces STRING")
    other = spark.range(30_000).selectExpr("id + 1000 AS decoded_id", "CAST(100 + id % 7 AS INT) AS dict_id", "concat('/ま', translate(CAST(id AS STRING), '0123456789', 'ぱぴぷぺぽがぎぐげご'), '/') AS surfaces")
    judge = lambda df: sorted(tuple(r) for r in encodings.repaired_records(df, "decoded_id", "dict_id", "surfaces").where("decoded_id < 1000").collect())
    alone = judge(own)
    assert alone == judge(own.unionByName(other)) and sum(r[1] for r in alone) >= 57
