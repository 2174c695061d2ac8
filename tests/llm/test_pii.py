import os
import random
import re
from collections import Counter

from kotonami.llm import pii

CASES = [
    ("返事はtaro.yamada@example.comまでください。", [("email", "taro.yamada@example.com")]),
    ("宛先=taro_y [at] mail.example;差出人=山川　花子\n", [("email", "taro_y [at] mail.example"), ("name", "山川　花子")]),
    ("連絡先：ｔａｒｏ＠ｅｘａｍｐｌｅ．ｊｐ / TEL ０９０－１２３４－５６７８", [("email", "ｔａｒｏ＠ｅｘａｍｐｌｅ．ｊｐ"), ("phone", "０９０－１２３４－５６７８")]),
    ("電話　(03)1234-5678", [("phone", "(03)1234-5678")]),
    ("You can call me at (555) 555-0100 after six.", [("phone", "(555) 555-0100")]),
    ("個人番号は123456789018です。", [("id_number", "123456789018")]),
    ("ログにAB1234567（旅券番号）が残っていた。", [("id_number", "AB1234567")]),
    ("my Social security number is 123-45-6789, please", [("id_number", "123-45-6789")]),
    ("住所　〒123-4567 東京都灯市緑町1丁目2番3号", [("address", "〒123-4567 東京都灯市緑町1丁目2番3号")]),
    ("送り先は灯市緑町8-7-6、山川花子宛でお願いします。", [("address", "灯市緑町8-7-6"), ("name", "山川花子")]),
    ("My address is 340 Herons Road, Quill.", [("address", "340 Herons Road")]),
    ("はじめまして。山川と申します。", [("name", "山川")]),
    ("登録名「ヤマカワ ハナコ」の読みが出ません。", [("name", "ヤマカワ ハナコ")]),
    ("According to Maren Ormsley, it was right.", [("name", "Maren Ormsley")]),
    ("株式会社山川。山川製作所。灯市のイベント。@kana_bot icon@2x.png https://docs.example/1/yamakawa ビルド 202308041308 2023-01-01 10:00 伝票 40413598", []),
]


def test_cases():
    finder = pii.Finder()
    for text, want in CASES:
        assert [(s.kind, text[s.start : s.end]) for s in finder.spans(text)] == want, text


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.individual_number("123456789018") and not pii.individual_number("123456789012")


def test_folding_keeps_positions():
    for text, _ in CASES:
        assert len(pii.folded(text)) == len(text)


def test_redaction():
    assert pii.Finder().redacted("電話　090-1234-5678。返事はa@example.comまで") == "電話　[PHONE]。返事は[EMAIL]まで"
    assert pii.Finder().redacted(None) is None and pii.Finder().redacted("") == ""


def test_tables_and_learned_names(spark):
    data = [(i, "お世話になっております。\n山川花子と申します。\n本文です。") for i in range(3)] + [(9, "本文です。\n\n山川花子"), (10, "本文です。\n\n今日の天気"), (11, None), (12, ""), (13, "あ。" * 200_000), (9, "本文です。\n\n山川花子")]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id BIGINT, text STRING, kind INT")
    got = sorted((r["doc_id"], r["kind"], r["start_pos"]) for r in pii.mentions(df, "doc_id", "text").collect())
    assert got == [(0, "name", 13), (1, "name", 13), (2, "name", 13), (9, "name", 7), (9, "name", 7)]
    red = {r["doc_id"]: r["text"] for r in pii.redacted_texts(df, "doc_id", "text").collect()}
    assert red[9].endswith("\n\n[NAME]") and red[11] is None and len(red[13]) == 400_000
    assert pii.mentions(df.limit(0), "doc_id", "text").collect() == []


def test_weak_names_after_stop_words_and_short_parts():
    finder = pii.Finder({"Maren": 3, "Ormsley": 3, "太郎": 3, "花子": 3, "ヤマカワ": 3})
    for text, want in [("本文です。\n\nCc Maren Ormsley", "Maren Ormsley"), ("本文です。\n\nThanks Maren Ormsley\n", "Maren Ormsley"), ("本文です。\n\n林 太郎", "林 太郎"), ("本文です。\n\n森　花子\n", "森　花子"), ("本文です。\n\nCc Quill Harbor", None)]:
        assert [text[s.start : s.end] for s in finder.spans(text)] == ([want] if want else []), text


def test_skipped_proposals_have_no_mention():
    class Whole(pii.Finder):
        def _may_be_known(self, name):
            return True

    random.seed(4)
    words = ["Cc", "Thanks", "Maren", "MAREN", "Ormsley", "Dear,", "Q.", "林", "太郎", "山川", "花子", "はな", "はなこ", "ヤマカワ", "様", "です", "\n", "\n", "。", " ", " ", "　", ",", ", "]
    for _ in range(5000):
        lexicon = dict.fromkeys(random.sample(["Maren", "Ormsley", "太郎", "山川", "花子", "はな", "ヤマカワ", "Cc"], 3), 3)
        text = "".join(random.choices(words, k=12))
        assert pii.Finder(lexicon).spans(text) == Whole(lexicon).spans(text), text


def test_rare_names_in_a_large_corpus(spark):
    rare = [(i, "お世話になっております。\n山川花子と申します。\n本文です。") for i in range(-3, 0)] + [(-4, "本文です。\n\n山川花子")]
    df = spark.createDataFrame(rare, "doc_id BIGINT, text STRING").unionByName(spark.range(200_000).selectExpr("id AS doc_id", "'本文です。' AS text"))
    assert {r["doc_id"] for r in pii.mentions(df, "doc_id", "text").collect()} == {-4, -3, -2, -1}


def test_joined_lexicon_gives_the_same(spark, monkeypatch):
    random.seed(5)
    names = ["山川花子", "林 太郎", "Maren Ormsley", "ヤマカワ ハナコ", "森 はなこ", "QUILL HERONS"]
    data = [(100 * k + i, f"はじめまして。\n{n}と申します。\n-- \n{n}\n") for k, n in enumerate(names) for i in range(k)]
    data += [(1000 + i, "本文です。\n\n" + random.choice(["", "Cc ", "Thanks "]) + random.choice([*names, "花子", "はなこです", "林太郎", "山川様"]) + "\n") for i in range(60)]
    data += [(2000, None), (2001, None), (2002, ""), (1000, data[-60][1]), data[0], (None, "本文です。\n\nMaren Ormsley")]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    seen = []
    for bound in (pii.BROADCAST_PARTS, 0):
        monkeypatch.setattr(pii, "BROADCAST_PARTS", bound)
        found = sorted(pii.mentions(df, "doc_id", "text").collect(), key=str)
        seen.append((found, sorted(pii.redacted_texts(df, "doc_id", "text").collect(), key=str)))
    assert seen[0] == seen[1] and len(seen[0][0]) > 50 and len(seen[0][1]) == len(data)


def test_lookups_hold_what_the_search_asks_for():
    random.seed(6)
    words = ["Cc", "Maren", "MAREN", "Ormsley", "林", "太郎", "山川", "花子", "はな", "はなこ", "ヤマカワ", "様", "です", "と申します", "\n", "\n", "。", " ", ", "]
    for _ in range(3000):
        lexicon = dict.fromkeys(random.sample(["Maren", "Ormsley", "太郎", "山川", "花子", "はな", "ヤマカワ", "Cc"], 4), 3)
        text = "".join(random.choices(words, k=12))
        own = pii.Finder().lookups(pii.folded(text))
        assert pii.Finder(lexicon).spans(text) == pii.Finder({p: 3 for p in lexicon if p in own}).spans(text), text


def held_out():
    """(text, its mentions) of sentences written apart from any given table."""
    with open(os.path.join(os.path.dirname(__file__), "pii_held_out.txt"), encoding="utf-8") as f:
        for line in f.read().splitlines():
            text, spans, at = "", set(), 0
            line = line.replace("\\n", "\n")
            for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
                text += line[at : m.start()]
                spans.add((m[1], len(text)))
                text, at = text + m[2], m.end()
            yield text + line[at:], spans


def test_held_out_sentences():
    finder, both, missed, wrong = pii.Finder(), Counter(), Counter(), Counter()
    for text, want in held_out():
        got = {(s.kind, s.start) for s in finder.spans(text)}
        for c, found in ((both, want & got), (missed, want - got), (wrong, got - want)):
            c.update(k for k, _ in found)
    for kind in pii.KINDS:
        assert both[kind] >= 0.9 * (both[kind] + missed[kind]) and both[kind] >= 0.9 * (both[kind] + wrong[kind]), kind


def test_a_valid_card_number_needs_no_words():
    find = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.Finder().spans(t)]
    assert find("It was 4111 1111 1111 1111 then") == [("id_number", "4111 1111 1111 1111")]
    assert find("It was 4111 1111 1111 1112 then") == [] and find("It was 1673882056003 then") == []


def test_mentions_and_redaction_in_one_pass(spark):
    df = spark.createDataFrame([(1, "電話　090-1234-5678。"), (2, None), (None, "")], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["spans"], r["redacted"]) for r in pii.annotated_texts(df, "doc_id", "text").collect()}
    assert got[1][1] == "電話　[PHONE]。" and [tuple(s)[:3] for s in got[1][0]] == [("phone", 3, 16)] and got[2] == ([], None) and got[None] == ([], "")
