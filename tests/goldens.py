"""Known results of scalar and clause functions, as queries over small literal tables. Their inputs and results are fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions import romaji, text
from kotonami.operators import clauses, counts, dictionary, evaluate, training
from kotonami.streaming import ime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def golden(name: str, schema: str, rows: list[tuple], build: Callable[[DataFrame], DataFrame], columns: list[str], expected: list[tuple]) -> None:
    """A query over literal rows, and its expected rows as SQL."""
    QUERIES[name] = lambda spark, sf_dir: build(spark.createDataFrame(rows, schema))
    SQL[name] = _values(expected, columns)


def mapped(name: str, function: Callable[[Column], Column], pairs: list[tuple[str, object]]) -> None:
    """A golden query of a function of one string."""
    golden(name, "input STRING", [(a,) for a, _ in pairs], lambda df: df.select("input", function(F.col("input")).alias("output")), ["input", "output"], pairs)


mapped("romaji_to_hiragana", romaji.to_hiragana, [
    ("a", "あ"), ("ba", "ば"), ("hi", "ひ"), ("wahaha", "わはは"), ("thi", "てぃ"), ("better", "べってr"), ("[", "「"), ("]", "」"), ("wo", "を"), ("du", "づ"), ("we", "うぇ"), ("di", "ぢ"), ("fu", "ふ"),
    ("ti", "ち"), ("wi", "うぃ"), ("z,", "‥"), ("z.", "…"), ("z/", "・"), ("z[", "『"), ("z]", "』"), ("sorenawww", "それなwww"), ("komitthi", "こみってぃ"), ("ddha", "っでゃ"), ("jje", "jじぇ"), ("zzye", "っじぇ"), ("tanni", "たんい"), (None, None), ("", ""),
])
mapped("romaji_remove_last", romaji.remove_last_char, [("aka", "a"), ("sona", "so"), ("son", "so"), ("sonn", "so"), ("sonnna", "sonn"), ("sozh", "so"), ("", "")])
mapped("consonant_preedit", lambda c: text.consonant_suffix(c)["preedit"], [("meny", "me"), ("menn", "menn"), ("u-nnwwww", "u-nn"), ("zh", "zh"), ("a", "a")])
mapped("consonant_rest", lambda c: text.consonant_suffix(c)["suffix"], [("meny", "ny"), ("menn", ""), ("u-nnwwww", "wwww"), ("zh", ""), ("a", "")])
mapped("kansuji", lambda c: text.kansuji(c.cast("bigint")), [("0", "零"), ("1", "一"), ("9", "九"), ("10", "十"), ("11", "十一"), ("20", "二十"), ("100", "百"), ("1000", "千"), ("1001", "千一"), ("10000", "一万"), ("10020", "一万二十"), ("180004423", "一億八千万四千四百二十三"), ("-3", "マイナス三"), (None, None)])
mapped("hiragana_to_katakana", text.hira2kata, [("わたし", "ワタシ"), ("ゔー", "ヴー"), ("漢字", "漢字")])
mapped("katakana_to_hiragana", text.kata2hira, [("ワタシ", "わたし"), ("ヴー", "ゔー"), ("漢字", "漢字")])
mapped("half_width_kana", text.half_kana, [("ガギパ", "ｶﾞｷﾞﾊﾟ"), ("アー。", "ｱｰ｡"), ("ヴ", "ｳﾞ")])
mapped("full_width_kana", text.full_kana, [("ｶﾞｷﾞﾊﾟ", "ガギパ"), ("ｱｰ｡", "アー。"), ("ｳﾞ", "ヴ")])
mapped("full_width_ascii", text.full_ascii, [("a1 !", "ａ１　！")])
mapped("half_width_ascii", text.half_ascii, [("ａ１　！", "a1 !")])
mapped("readings_stripped", text.strip_readings, [("上級個人情報保護士（じょうきゅうこじんじょうほうほごし）は", "上級個人情報保護士は"), ("東京(とうきょう、とうけい)だ", "東京だ"), ("式（a）", "式（a）")])
mapped("ruby_stripped", text.strip_ruby, [("小《ちひ》さな", "小さな"), ("a《b》c《d》", "ac")])
mapped("notes_stripped", text.strip_notes, [("上［＃「上」に傍点］の下［＃改行］", "上")])
mapped("old_kana", text.is_kyukana, [("小さな", False), ("ヰ", True), ("ゑ", True)])
mapped("meta_stripped", text.strip_meta, [("META\n" + "-" * 12 + "\nDOOO", "DOOO"), ("HOGE\n底本：めためた", "HOGE\n"), ("HELLO", "HELLO")])
mapped("trimmed", text.trim_unicode, [("　 a b　\t", "a b"), ("", "")])
mapped("segment_numbers", text.segment_number, [("365日", "365"), ("3.14x", "3.14"), ("007", "0"), ("わ", "")])
mapped("bypassed", ime.bypasses, [("Hello", True), ("https://x", True), ("hello", False)])
mapped("key_chords", lambda c: F.concat_ws(",", text.key_chord(c)["ctrl"].cast("string"), text.key_chord(c)["shift"].cast("string"), text.key_chord(c)["key"]), [("C-h", "true,false,h"), ("C-S-h", "true,true,h"), ("h", "false,false,h")])
mapped("mecab_features", lambda c: F.concat_ws("|", *[text.mecab_features(c, F.lit("書く"))[f] for f in ("hinshi", "subhinshi", "subsubhinshi", "yomi")]), [("動詞,自立,*,*,五段,連用形,書く,カイ,カイ", "動詞|自立|*|かい"), ("名詞", "名詞|UNK|UNK|書く")])

golden("dynamic_surfaces", "surface STRING, yomi STRING", [("(*(*(TODAY-HYPHEN", "x"), ("(*(*(TODAY-SLASH", "x"), ("(*(*(TODAY-KANJI", "x"), ("(*(*(NOW-KANJI", "x"), ("(*(*(NUMBER-KANSUJI", "365"), ("(*(*(NUMBER-KANSUJI", "3."), ("(*(*(WHAT", "x"), ("今日", "x")],
    lambda df: df.select("surface", "yomi", text.dynamic_surface(F.col("surface"), F.col("yomi"), F.timestamp_seconds(F.lit(1673882056))).alias("shown")), ["surface", "yomi", "shown"],
    [("(*(*(TODAY-HYPHEN", "x", "2023-01-16"), ("(*(*(TODAY-SLASH", "x", "2023/01/16"), ("(*(*(TODAY-KANJI", "x", "2023年01月16日"), ("(*(*(NOW-KANJI", "x", "15時14分"), ("(*(*(NUMBER-KANSUJI", "365", "三百六十五"), ("(*(*(NUMBER-KANSUJI", "3.", "3."), ("(*(*(WHAT", "x", "不明な動的変換: (*(*(WHAT"), ("今日", "x", "今日")])

_EDITS = [("right", "わ", 0), ("right", "わ|た", 0), ("right", "わ|たし", 0), ("right", "あい|ですね", 1), ("left", "わ", 0), ("left", "わ|た", 0), ("left", "わだ|た|そ", 0), ("left", "わだ|た|そ", 1), ("left", "およよよあ", 0), ("left", "や|まと", 1)]
golden("clauses_extended", "op STRING, c STRING, focus INT", _EDITS,
    lambda df: df.withColumn("cs", F.split("c", "[|]")).select("op", F.col("c").alias("before"), "focus", F.array_join(F.when(F.col("op") == "right", clauses.extend_right(F.col("cs"), F.col("focus"))).otherwise(clauses.extend_left(F.col("cs"), F.col("focus"))), "|").alias("after")),
    ["op", "before", "focus", "after"], [(*e, a) for e, a in zip(_EDITS, ["わ", "わた", "わた|し", "あい|ですね", "わ", "わ|た", "わ|だた|そ", "わ|だた|そ", "およよよ|あ", "やまと"])])
golden("clause_ranges", "c STRING", [("わたし|の",), ("あ",)], lambda df: df.select("c", F.explode(clauses.ranges(F.split("c", "[|]"))).alias("r")).select("c", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos")), ["c", "start_pos", "end_pos"], [("わたし|の", 0, 3), ("わたし|の", 3, 4), ("あ", 0, 1)])
golden("focus_moved", "focus INT, n INT, step INT", [(0, 3, -1), (2, 3, 1), (1, 3, 1), (0, 0, 1)], lambda df: df.select("focus", "n", "step", F.when(F.col("step") > 0, clauses.moved_focus(F.col("focus"), F.col("n"), 1)).otherwise(clauses.moved_focus(F.col("focus"), F.col("n"), -1)).alias("moved")), ["focus", "n", "step", "moved"], [(0, 3, -1, 2), (2, 3, 1, 0), (1, 3, 1, 2), (0, 0, 1, 0)])
golden("input_states", "raw_input STRING, n INT", [("", 0), ("ka", 0), ("ka", 2)], lambda df: df.select("raw_input", "n", ime.input_state(F.col("raw_input"), F.col("n")).alias("state")), ["raw_input", "n", "state"], [("", 0, "PreComposition"), ("ka", 0, "Composition"), ("ka", 2, "Conversion")])
golden("preedit_shown", "raw_input STRING, mode STRING", [("hogen", "hiragana"), ("hogen", "katakana"), ("ga", "half_katakana"), ("ab", "fullwidth_alnum"), ("Ab", "hiragana")], lambda df: df.select("raw_input", "mode", ime.preedit(F.col("raw_input"), F.col("mode")).alias("shown")), ["raw_input", "mode", "shown"], [("hogen", "hiragana", "ほげn"), ("hogen", "katakana", "ホゲn"), ("ga", "half_katakana", "ｶﾞ"), ("ab", "fullwidth_alnum", "ａｂ"), ("Ab", "hiragana", "Ab")])
golden("direct_conversions", "raw_input STRING, kind STRING", [("ka", "hiragana"), ("ka", "katakana"), ("ga", "half_katakana"), ("ka", "full_romaji"), ("ka", "half_romaji")], lambda df: df.select("raw_input", "kind", ime.direct_conversion(F.col("raw_input"), F.col("kind")).alias("shown")), ["raw_input", "kind", "shown"], [("ka", "hiragana", "か"), ("ka", "katakana", "カ"), ("ga", "half_katakana", "ｶﾞ"), ("ka", "full_romaji", "ｋａ"), ("ka", "half_romaji", "ka")])


def _keys(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    parent = ime.key_table(spark.createDataFrame([(["Composition"], ["C-h", "BackSpace"], "erase"), (["Composition", "Conversion"], ["space"], "update_candidates")], "states ARRAY<STRING>, keys ARRAY<STRING>, command STRING"))
    child = ime.key_table(spark.createDataFrame([(["Conversion"], ["space"], "cursor_down"), (["Composition"], ["C-h"], None)], "states ARRAY<STRING>, keys ARRAY<STRING>, command STRING"))
    return ime.dispatched(df, ime.extended_keys(parent, child)).select("state", "ctrl", "shift", "key", "command")


golden("keys_dispatched", "state STRING, ctrl BOOLEAN, shift BOOLEAN, key STRING", [("Composition", True, False, "h"), ("Composition", False, False, "BackSpace"), ("Conversion", False, False, "space"), ("Composition", False, False, "space")], _keys, ["state", "ctrl", "shift", "key", "command"],
    [("Composition", True, False, "h", None), ("Composition", False, False, "BackSpace", "erase"), ("Conversion", False, False, "space", "cursor_down"), ("Composition", False, False, "space", "update_candidates")])

_SKK = [(0, 0, ";; okuri-ari entries."), (0, 1, "いu /言/"), (0, 2, "あいしあw /愛し合/"), (0, 3, ";; okuri-nasi entries."), (0, 4, "こな /粉/"), (0, 5, "せみころん /; [Semicolon]/"), (0, 6, "お /尾/"), (0, 7, "kk /株式会社/"), (0, 8, "お /緒;note/尾/"), (0, 9, "")]
golden("skk_parsed", "src_rank INT, line_no INT, line STRING", _SKK, lambda df: dictionary.parse_lines(df).select("section", "yomi", F.array_join("surfaces", "/").alias("surfaces")), ["section", "yomi", "surfaces"], [("ari", "いu", "言"), ("ari", "あいしあw", "愛し合"), ("nasi", "こな", "粉"), ("nasi", "せみころん", ""), ("nasi", "お", "緒/尾")])
golden("skk_okuri", "src_rank INT, line_no INT, line STRING", _SKK, lambda df: dictionary.expand_okuri(dictionary.parse_lines(df).where("section = 'ari'").select("yomi", "surfaces")).select("yomi", F.array_join("surfaces", "/").alias("surfaces")), ["yomi", "surfaces"], [("いう", "言う"), ("あいしあわ", "愛し合わ"), ("あいしあうぃ", "愛し合うぃ"), ("あいしあうぇ", "愛し合うぇ"), ("あいしあを", "愛し合を")])
golden("unidic_words", "line_no INT, line STRING", [(0, "カタカナ,0,0,0,名詞,x,x,x,x,x,カタカナ,x"), (1, "漢字,0,0,0,名詞,x,x,x,x,x,カンジ,x"), (2, "短い,1"), (3, "テスト,0,0,0,名詞,x,x,x,x,x,テスト")], lambda df: dictionary.from_unidic(df.select("line_no", F.split("line", ",", -1).alias("c"))).select("yomi", F.array_join("surfaces", "/").alias("surfaces")), ["yomi", "surfaces"], [("かたかな", "カタカナ"), ("てすと", "テスト")])
golden("eval_lines", "line STRING", [("# x",), ("|あした|とどく| |明日|届く|",), ("",)], lambda df: evaluate.eval_rows(df), ["yomi", "surface"], [("あしたとどく", "明日届く")])
golden("recall_scored", "surface STRING, got STRING", [("東京都", "東京都"), ("今日は雨", "今日は飴"), ("abc", "")], lambda df: evaluate.scores(df).select("good", "bad", F.round("recall", 4).alias("recall")), ["good", "bad", "recall"], [(1, 2, round(600 / 7, 4))])
golden("lcs_lengths", "a STRING, b STRING", [("abcbdab", "bdcaba"), ("", "a"), ("あいう", "いう"), ("x", None)], lambda df: df.select("a", "b", text.lcs_length(F.col("a"), F.col("b")).alias("n")), ["a", "b", "n"], [("abcbdab", "bdcaba", 4), ("", "a", 0), ("あいう", "いう", 2), ("x", None, None)])
golden("annotated_parsed", "sent_id BIGINT, line STRING", [(1, "__BOS__/__BOS__ コーパス/こーぱす の/の 文 __EOS__/__EOS__"), (2, ";; x"), (3, "/よみ a/b")], lambda df: training.parse_annotated(df), ["sent_id", "i", "surface", "yomi", "start_pos"], [(1, 0, "コーパス", "こーぱす", 0), (1, 1, "の", "の", 4), (1, 2, "文", "文", 5)])
golden("tokenized_words", "line STRING", [("私/わたし は/は  私/わたし /x ",), (None,), ("",)], lambda df: counts.word_frequencies(counts.words_of_lines(df, "line")), ["word", "cnt"], [("私/わたし", 2), ("は/は", 1)])
