"""Morphemes to words: kana-preferred surfaces and the merging of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.operators.ordered import distinct_by_group, is_crowded, running, with_previous

COLUMNS = ["surface", "yomi", "hinshi", "subhinshi", "subsubhinshi"]


def prefer_kana(surface: Column, yomi: Column, hinshi: Column, subhinshi: Column, preferred: bool) -> Column:
    """The reading in place of the surface for pronouns and words that are usually written in kana."""
    if not preferred:
        return surface
    return F.when((subhinshi == "代名詞") | hinshi.isin("形容詞", "副詞", "接続詞", "感動詞", "動詞"), yomi).otherwise(surface)


def merge_tokens(tokens: DataFrame) -> DataFrame:
    """(sent_id, run, word): runs of morphemes joined to words 'surface/yomi'; `run` is the i of its first one.

    `tokens`: sent_id, i and COLUMNS. A morpheme joins the one before if it is an auxiliary
    behind a verb or auxiliary, a conjunctive particle or a suffix. 家 and か behind a person's
    name read け. Exact copies count once; morphemes with a null or blank surface are left
    out, a null reading is the surface.
    """
    crowded = is_crowded(tokens, "sent_id")
    clean = tokens.select("sent_id", "i", *COLUMNS).where(F.col("surface").isNotNull() & F.col("surface").rlike(r"[^\p{Z}\x09-\x0d]")).withColumn("yomi", F.coalesce("yomi", "surface"))
    seen = with_previous(distinct_by_group(clean, "sent_id", crowded), "sent_id", "i", COLUMNS, crowded)
    verb = (F.col("hinshi") == "助動詞") & F.col("prev.hinshi").isin("動詞", "助動詞")
    joins = F.coalesce(F.col("prev").isNotNull() & (F.coalesce(verb, F.lit(False)) | F.coalesce(F.col("subhinshi").isin("接続助詞", "接尾"), F.lit(False))), F.lit(False))
    reading = F.when(joins & F.col("surface").isin("家", "か") & (F.col("prev.subsubhinshi") == "人名"), "け").otherwise(F.col("yomi"))
    marked = seen.select("sent_id", "i", "surface", reading.alias("yomi"), F.when(~joins, F.col("i")).alias("start"))
    runs = running(marked, "sent_id", "i", F.col("start"), "run", how="max", crowded=crowded)
    joined = lambda c: F.expr(f"listagg({c}, '') WITHIN GROUP (ORDER BY i)")
    words = runs.groupBy("sent_id", "run").agg(joined("surface").alias("s"), joined("yomi").alias("y"))
    return words.select("sent_id", "run", F.concat("s", F.lit("/"), "y").alias("word"))
