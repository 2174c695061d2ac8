"""Sinks: models, word lists and dictionaries; every write is one committed Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_wfreq(wfreq: DataFrame, path: str) -> None:
    """Lines 'word TAB count' in byte order of words."""
    wfreq.orderBy("word").select(F.concat_ws("\t", "word", F.col("cnt").cast("string"))).write.mode("overwrite").text(path)


def read_wfreq(spark: SparkSession, path: str, threshold: int = 0) -> DataFrame:
    """(word, cnt) of such lines, above the threshold; a line without a count is an error."""
    cut = spark.read.text(path).select(F.split("value", "\t", -1).alias("p"))
    return cut.select(F.get("p", F.lit(0)).alias("word"), F.coalesce(F.get("p", F.lit(1)), F.raise_error("no count").cast("string")).cast("bigint").alias("cnt")).where(F.col("cnt") > threshold)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("word").orderBy("word").write.mode("overwrite").text(path)


def skk_lines(dictionary: DataFrame) -> DataFrame:
    """(value) 'yomi /a/b/' in order of readings."""
    return dictionary.orderBy("yomi").select(F.concat("yomi", F.lit(" /"), F.array_join("surfaces", "/"), F.lit("/")).alias("value"))


def write_skk(dictionary: DataFrame, path: str) -> None:
    """A dictionary file: both section headers, all entries in the second section, in one part."""
    spark = dictionary.sparkSession
    head = spark.createDataFrame([(0, ";; okuri-ari entries."), (1, ";; okuri-nasi entries.")], "k INT, value STRING")
    body = skk_lines(dictionary).withColumn("k", F.lit(2))
    head.unionByName(body.select("k", "value")).orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_model(path: str, unigram: DataFrame, bigram: DataFrame, stats: DataFrame) -> None:
    """A model folder: unigram, bigram and the one row of totals, each a table."""
    for name, df in (("unigram", unigram), ("bigram", bigram), ("stats", stats)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a model folder; totals that are missing are an error."""
    unigram, bigram, stats = (spark.read.parquet(f"{path}/{n}") for n in ("unigram", "bigram", "stats"))
    if stats.isEmpty():
        raise ValueError(f"no totals in {path}")
    return unigram, bigram, stats


def write_tokens(sentences: DataFrame, path: str) -> None:
    """Tokenized sentences (sent_id, run, word) as lines of words."""
    lists = sentences.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("run", "word"))).alias("w"))
    lists.select(F.array_join(F.transform("w", lambda x: x["word"]), " ")).write.mode("overwrite").text(path)


def write_user_stats(counts: DataFrame, path: str) -> None:
    """Lines 'key count'."""
    counts.select(F.concat_ws(" ", "key", F.col("cnt").cast("string"))).write.mode("overwrite").text(path)


def write_by_source(rows: DataFrame, source: str, path: str) -> None:
    """Rows in a folder for each source that they come from; two files of one name stay apart."""
    rows.withColumn("source_key", F.regexp_replace(source, "[^A-Za-z0-9_.-]", "_")).write.mode("overwrite").partitionBy("source_key").parquet(path)


def snapshot(rows: DataFrame, folder: str, name: str, stamp: str) -> str:
    """A copy beside the others of its name; gives its path."""
    at = f"{folder}/{stamp}-{name}"
    rows.write.mode("error").parquet(at)
    return at
