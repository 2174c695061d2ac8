import base64
import os
import random

import pytest

from kotonami.llm import tokenizer

VOCABULARY = os.environ.get("KOTONAMI_VOCABULARY", tokenizer.DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
ALPHABET = list("abcdefghijklmnopqrstuvwxyz ing thetionERAÄéаяΩ日本のー東京ンスト🍣 0123456789''s\n\t ")


@pytest.fixture(scope="module")
def own():
    return tokenizer.BpeTransducer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(4)
    yield from ("".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(3000))
    yield from ("a" * 5000, "ab" * 3000, "あ" * 3000, " " * 3000, "\n\n  x", "<|endoftext|>", "1" * 4000, "", "\0", "I'll they've")


def test_ids_and_round_trip(own, public):
    for t in texts():
        ids = own.encode(t)
        assert ids == public.encode_ordinary(t), t[:80]
        assert "".join(own.decode(ids)) == t


def test_bounded_memory_changes_nothing(public):
    small = tokenizer.BpeTransducer.from_file(VOCABULARY)
    small.keep = 500
    for t in list(texts())[:400]:
        assert small.encode(t) == public.encode_ordinary(t)


def test_stream_of_bytes():
    for data in (b"\xe3\x81\x82\xff\xe3\x81", "🍣é".encode(), b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf"):
        for cut in range(len(data) + 1):
            s = tokenizer.Utf8Stream()
            got = s.feed(data[:cut]) + s.feed(data[cut:]) + s.close()
            assert got == data.decode("utf-8", "replace")


def test_table(spark):
    df = spark.createDataFrame([(1, "日本", "x"), (2, None, "y"), (3, "", "z"), (1, "日本", "x")], "doc_id BIGINT, text STRING, ids STRING")
    got = sorted((r["doc_id"], r["ids"]) for r in tokenizer.encode_texts(df, "doc_id", "text", VOCABULARY).collect())
    assert [len(i) > 0 for _, i in got] == [True, True, False, False] and got[0] == got[1]
    back = tokenizer.decode_ids(tokenizer.encode_texts(df, "doc_id", "text", VOCABULARY), "doc_id", "ids", VOCABULARY)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [(1, "日本"), (1, "日本"), (2, ""), (3, "")]
    assert tokenizer.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).collect() == []
