import pytest
from conftest import rows
from pyspark.sql import functions as F

from kotonami.plans.engine import Engine
from kotonami.streaming import session, userdata
from kotonami.streaming.session import COMMANDS, Loop, Session, by_dictionary

WORDS = {"わたし": ["私", "渡し"], "わた": ["綿"], "し": ["市", "死"], "かい": [f"会{k}" for k in range(12)]}


def typed(loop, s, text):
    for ch in text:
        s, used = loop.key(s, None, ch)
        assert used
    return s


def test_commands_of_a_session():
    assert len(COMMANDS) == 33
    loop = Loop(by_dictionary(WORDS))
    s = typed(loop, Session(), "watashi")
    assert s.state == "Composition"
    s = loop.command(s, "update_candidates")
    assert s.state == "Conversion" and s.text() == "私"
    assert loop.command(s, "cursor_down").text() == "渡し" and loop.command(s, "cursor_up").text() == "ワタシ"
    s = loop.command(s, "extend_clause_left")
    assert [c[0][1] for c in s.clauses] == ["わた", "し"] and s.text() == "綿市"
    s = loop.command(loop.command(s, "cursor_right"), "press_number_2")
    assert s.focus == 1 and s.text() == "綿死" and loop.command(s, "press_number_9") is None
    assert loop.command(s, "cursor_right").focus == 0
    back = loop.command(loop.command(s, "cursor_left"), "extend_clause_right")
    assert [c[0][1] for c in back.clauses] == ["わたし"]
    done = loop.command(s, "commit_candidate")
    assert done.state == "PreComposition" and done.commits == (("綿死", (("綿", "わた", False), ("死", "し", False))),)
    assert loop.command(s, "escape").state == "Composition" and loop.command(loop.command(s, "escape"), "escape").state == "PreComposition"
    with pytest.raises(ValueError):
        loop.command(s, "no_such_command")


def test_pages_modes_and_direct_conversions():
    loop = Loop(by_dictionary(WORDS))
    s = loop.command(typed(loop, Session(), "kai"), "update_candidates")
    assert loop.command(s, "page_up").chosen == (0,) and loop.command(s, "page_down").chosen == (10,) and loop.command(loop.command(s, "page_down"), "press_number_0") is None
    assert loop.command(loop.command(s, "page_down"), "press_number_2").text() == "会11"
    raw = typed(loop, Session(), "gakko")
    shown = {c: loop.command(raw, f"convert_to_{c}").text() for c in ("full_hiragana", "full_katakana", "half_katakana", "full_romaji", "half_romaji")}
    assert shown == {"full_hiragana": "がっこ", "full_katakana": "ガッコ", "half_katakana": "ｶﾞｯｺ", "full_romaji": "ｇａｋｋｏ", "half_romaji": "gakko"}
    assert loop.command(raw, "erase_character_before_cursor").raw == "ga"
    kata = loop.command(Session(), "set_input_mode_katakana")
    assert loop.command(typed(loop, kata, "ka"), "commit_preedit").commits == (("カ", ()),)
    wide = loop.command(Session(), "set_input_mode_fullwidth_alnum")
    assert loop.key(wide, None, "a")[0].commits == (("ａ", ()),)
    assert loop.key(loop.command(Session(), "set_input_mode_alnum"), None, "a") == (Session(mode="alnum"), False)
    assert loop.key(Session(), None, "a", modified=True)[1] is False
    assert loop.command(typed(loop, Session(), "Hello"), "update_candidates").text() == "Hello"


def test_sessions_as_groups(spark):
    keys = [(1, n, None, ch, False) for n, ch in enumerate("watashi")] + [(1, 7, "update_candidates", " ", False), (1, 8, None, "k", False), (1, 9, None, "a", False), (1, 10, "commit_preedit", None, False)]
    keys += [(2, 0, None, "a", False), (2, 1, "commit_preedit", None, False), (3, 0, "escape", None, False)]
    events = spark.createDataFrame(keys[::-1], "session_id BIGINT, seq INT, command STRING, char STRING, modified BOOLEAN")
    assert rows(session.run_sessions(events, by_dictionary(WORDS))) == [(1, 0, "私"), (1, 1, "か"), (2, 0, "あ")]


def engine(spark, **more):
    words = spark.createDataFrame([("わたし", ["渡し", "私"]), ("の", ["の"])], "yomi STRING, surfaces ARRAY<STRING>")
    return Engine(spark.createDataFrame([("x/x", 0, 100)], "word STRING, word_id INT, cnt BIGINT"), spark.createDataFrame([(0, 0, 100)], "id1 INT, id2 INT, cnt BIGINT"), words, **more)


def test_live_conversion(spark, tmp_path):
    data = [(1, "w"), (2, "watashi"), (3, "watashino"), (4, "https://x"), (5, "Watashi"), (6, "")]
    assert rows(session.live_texts(engine(spark), spark.createDataFrame(data, "sent_id BIGINT, raw_input STRING"))) == [(1, "w"), (2, "渡し"), (3, "渡しの"), (4, "https://x"), (5, "Watashi")]
    spark.createDataFrame(data, "sent_id BIGINT, raw_input STRING").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sent_id BIGINT, raw_input STRING").parquet(str(tmp_path / "in"))
    session.live_stream(engine(spark), stream, str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "texts")).where("surface = '渡しの'").count() == 1


def test_forced_ranges(spark):
    df = spark.createDataFrame([(1, "watashino", [(0, 2), (2, 4)])], "sent_id BIGINT, raw_input STRING, force_ranges ARRAY<STRUCT<start: INT, end: INT>>")
    got = session.henkan(engine(spark), df).where("rank = 1").orderBy("clause_i").collect()
    assert [r["yomi"] for r in got] == ["わた", "しの"]


def test_commits_teach(spark, tmp_path):
    """What a user chose once comes first from then on."""
    store = userdata.UserStore(str(tmp_path / "store"))
    taught = lambda: engine(spark, user_unigram=store.read(spark, "unigram"), user_bigram=store.read(spark, "bigram"))
    assert taught().check("わたしの") == "渡し/の"
    schema = "sent_id BIGINT, raw_input STRING, choices ARRAY<STRUCT<clause_i: INT, rank: INT>>"
    spark.createDataFrame([(1, "watashino", [(0, 2)])], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    session.commit_stream(taught, stream, store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.read(spark, "unigram")) == [("の/の", 1), ("私/わたし", 1)]
    assert taught().check("わたしの") == "私/の"


def test_committed_text(spark):
    commits = spark.createDataFrame([(1, 1, "の", "の", False), (1, 0, "(*(*(NUMBER-KANSUJI", "12", False)], userdata.COMMIT_SCHEMA)
    assert rows(session.committed_text(commits, F.current_timestamp())) == [(1, "十二の")]
