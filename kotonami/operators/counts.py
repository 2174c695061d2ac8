"""Word and word-pair counts, vocabularies and count models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.operators.ordered import ranked, with_previous

UNIGRAM_CUT = 16
VOCABULARY_LIMIT = 8_388_608
#: Fixed value: words of two katakana with a reading of two hiragana, which analysers make of noise.
NOISE = "^[゠-ヿ]{2}/[぀-ゟ]{2}$"


def words_of_lines(df: DataFrame, line: str) -> DataFrame:
    """(word): blank-separated words of tokenized lines, without empty ones, right-to-left marks and leading slashes."""
    w = df.where(F.col(line).isNotNull()).select(F.explode(F.split(F.trim(F.col(line)), " ", -1)).alias("word"))
    return w.where(countable(F.col("word")))


def countable(word: Column) -> Column:
    return (word != "") & ~word.contains(chr(0x200F)) & ~word.startswith("/") & ~word.startswith(" ")


def word_frequencies(words: DataFrame) -> DataFrame:
    """(word, cnt), without noise words of two katakana."""
    return words.groupBy("word").agg(F.count("*").alias("cnt")).where(~F.col("word").rlike(NOISE))


def vocabulary(wfreq: DataFrame, threshold: int = UNIGRAM_CUT) -> DataFrame:
    """(word, cnt) of well-formed words above the threshold (strictly)."""
    return wfreq.where((F.col("cnt") > threshold) & F.col("word").contains("/") & ~F.trim("word").startswith("//"))


def numbered(vocab: DataFrame, limit: int = VOCABULARY_LIMIT) -> DataFrame:
    """`vocab` with word_id along the byte order of words; an error beyond the id space."""
    out = ranked(vocab, ["word"], "word_id")
    return out.withColumn("word_id", F.when(F.col("word_id") < limit, F.col("word_id")).otherwise(F.raise_error("vocabulary too large").cast("int")))


def bigram_counts(words: DataFrame, vocab: DataFrame, threshold: int = 0) -> DataFrame:
    """(id1, id2, cnt): neighbours of which both are in the vocabulary; an unknown word breaks the pair.

    `words`: sent_id, pos, word. Neighbours are found in the order of `pos` before any word is dropped.
    """
    ids = vocab.select(F.col("word").alias("w"), "word_id")
    pairs = with_previous(words.select("sent_id", "pos", "word"), "sent_id", "pos", ["word"]).where("prev is not null").select(F.col("prev.word").alias("word1"), F.col("word").alias("word2"))
    counted = pairs.groupBy("word1", "word2").agg(F.count("*").alias("cnt"))  # before the joins: each distinct pair is looked up once
    first = counted.join(ids.toDF("word1", "id1"), "word1")
    return first.join(ids.toDF("word2", "id2"), "word2").where(F.col("cnt") > threshold).select("id1", "id2", "cnt")


def with_words(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs of ids with their words."""
    ids = vocab.select("word_id", "word")
    return pairs.join(ids.toDF("id1", "word1"), "id1").join(ids.toDF("id2", "word2"), "id2")


def homograph_copies(wfreq: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """If one word of a pair is missing, it gets the count of the other."""
    table = wfreq.sparkSession.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "word STRING, other STRING")
    have = wfreq.join(F.broadcast(table), "word").select("other", "cnt")
    return wfreq.unionByName(have.join(wfreq.select(F.col("word").alias("other")), "other", "left_anti").select(F.col("other").alias("word"), "cnt"))


def raised_scores(wfreq: DataFrame, pairs: list[tuple[str, str]], stop_at_missing: bool = False) -> DataFrame:
    """The first word of a pair counts at least one more than the second; pairs with a missing word are left.

    With `stop_at_missing` the first missing word ends the list.
    """
    spark = wfreq.sparkSession
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    counts = wfreq.select(F.col("word").alias("w"), F.col("cnt").alias("n"))
    wanted = F.broadcast(table).join(counts.toDF("a", "na"), "a", "left").join(counts.toDF("b", "nb"), "b", "left")
    if stop_at_missing:
        gap = wanted.where("na is null or nb is null").agg(F.coalesce(F.min("i"), F.lit(len(pairs))).alias("gap"))
        wanted = wanted.withColumn("_one", F.lit(1)).join(F.broadcast(gap.withColumn("_one", F.lit(1))), "_one").where("i < gap").drop("_one", "gap")
    raised = wanted.where("na is not null and nb is not null").groupBy(F.col("a").alias("word")).agg(F.max(F.col("nb") + 1).alias("least"))
    return wfreq.join(F.broadcast(raised), "word", "left").select("word", F.greatest("cnt", F.coalesce("least", "cnt")).alias("cnt"))


def missing_words(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """`vocab` (word, word_id, cnt) with the words of `corpus` (sent_id, pos, word) that it lacks: count 1, ids on in order of first use."""
    first = corpus.groupBy("word").agg(F.min(F.struct("sent_id", "pos")).alias("at")).join(vocab.select("word"), "word", "left_anti")
    new = ranked(first.select("word", F.col("at.sent_id").alias("s"), F.col("at.pos").alias("p")), ["s", "p", "word"], "k")
    top = vocab.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("top"), F.lit(1).alias("_one"))
    new = new.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").select("word", (F.col("k") + 1 + F.col("top")).cast("int").alias("word_id"), F.lit(1).cast("bigint").alias("cnt"))
    return vocab.select("word", "word_id", F.col("cnt").cast("bigint").alias("cnt")).unionByName(new)


def rekeyed(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of ids of one vocabulary in the ids of another; pairs with a word it lacks go."""
    ids = old.select("word", F.col("word_id").alias("o")).join(new.select("word", F.col("word_id").alias("n")), "word").select("o", "n")
    other = [c for c in pairs.columns if c not in ("id1", "id2")]
    return pairs.join(ids.toDF("id1", "n1"), "id1").join(ids.toDF("id2", "n2"), "id2").select(F.col("n1").alias("id1"), F.col("n2").alias("id2"), *other)


def missing_pairs(pairs: DataFrame, vocab: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """(word1, word2) of pairs that a model must have and lacks, a word of the pair missing included."""
    need = vocab.sparkSession.createDataFrame(required, "word1 STRING, word2 STRING")
    return need.join(with_words(pairs, vocab).select("word1", "word2"), ["word1", "word2"], "left_anti")


def costs_of(keys: DataFrame, costed: DataFrame, on: list[str]) -> DataFrame:
    """`keys` with the count and cost that a costed model has for them; null where it has none."""
    return keys.join(costed.select(*on, "cnt", "cost"), on, "left")
