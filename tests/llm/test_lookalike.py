import random
from collections import Counter

from kotonami.llm import lookalike
from kotonami.llm.lookalike import Canonical, ScriptModel, normalized, symbols

WORDS = [("入力し", "にゅうりょくし"), ("作り", "つくり"), ("食べ", "たべ"), ("八金市", "はちきんし"), ("夕石", "せきせき"), ("工空練", "こうくうれん"), ("三口", "さんこう"), ("カーカ", "かーか"), ("ヘロリ", "へろり"), ("エチー", "えちー"), ("ロオー", "ろおー"), ("ゼーター", "ぜーたー"), ("API", "えーぴーあい"), ("ROM", "ろむ"), ("Kestrel", "けすとれる"), ("X-box", "えっくすぼっくす"), ("Salt Hollow", "そるとほろー"), ("café", "かふぇ"), ("🍣", "すし"), ("へ", "へ"), ("ニ", "に"), ("1019", "1019"), ("。", "。")]
DIRTY = [("入カし", 0), ("作リ", 1), ("食ベ", 2), ("ハ金市", 3), ("タ石", 4), ("エ空練", 5), ("三ロ", 6), ("力ー力", 7), ("へ口り", 8), ("工チ─", 9), ("口オ一", 10), ("ゼ−夕—", 11), ("ΑPΙ", 12), ("RОМ", 13), ("Кеstrel", 14), ("Ｘ‐ｂοx", 15), (f"Salt{chr(0x2003)}Нollow ", 16), ("cafe" + chr(0x301), 17), (chr(0x3000) + "🍣", 18), ("へ" + chr(0x200B), 19), ("二", 20), ("１０１９", 21), (f"。{chr(0xFE00)}", 22), ("Ꮶestreӏ", 14), ("Saӏt Hօllow", 16), ("ᎪPI", 12)]


def form():
    counts = Counter(p for w, _ in WORDS for _ in range(40) for p in zip(symbols(normalized(w)), symbols(normalized(w))[1:]))
    return Canonical(ScriptModel(counts))


def test_forms():
    f = form()
    for w, r in WORDS:
        assert f.surface(w, r) == w and f.reading(r) == r
    for dirty, k in DIRTY:
        assert f.surface(dirty, WORDS[k][1]) == WORDS[k][0], dirty
    assert [f.reading(r) for r in ("はしリ", "か一か", "たベ", "１２", "へ─", "カ", "__BOS__")] == ["はしり", "かーか", "たべ", "12", "へー", "か", "__BOS__"]
    assert f.surface("") == "" and f.surface("力" * 2000)


def test_found_in_a_table(spark):
    data = [(i, 0, w, r) for i in range(60) for w, r in WORDS] + [(100 + k, 0, d, WORDS[j][1]) for k, (d, j) in enumerate(DIRTY)] + [(300, 0, None, None), (301, 0, "作り", "つくリ"), (301, 0, "作り", "つくリ")]
    df = spark.createDataFrame(data, "sent_id INT, node_idx INT, surface STRING, yomi STRING")
    got = lookalike.canonical_values(df, ["sent_id", "node_idx"], "surface", "yomi").collect()
    assert len(got) == len(data)
    assert all(r["surface"] == r["surface_form"] for r in got if r["sent_id"] < 60)
    assert {r["sent_id"] for r in got if r["surface"] != r["surface_form"]} == set(range(100, 100 + len(DIRTY)))
    assert {r["sent_id"] for r in got if r["reading"] != r["reading_form"]} == {301}
    assert lookalike.canonical_values(df.limit(0), ["sent_id"], "surface", "yomi").collect() == []


def test_normalization_is_stable():
    random.seed(1)
    for _ in range(500):
        s = "".join(random.choice(["か", chr(0x3099), "ｶ", "ﾞ", "Ａ", " ", chr(0xA0), chr(0x200B), "⼒", "é", "ー"]) for _ in range(6))
        assert normalized(normalized(s)) == normalized(s)
