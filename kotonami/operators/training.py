"""Perceptron-like training: counts of the words of wrongly converted sentences move by a step.

A pass converts the whole corpus with the counts of the pass before and updates once (the
usual alternative, an update after each sentence, depends on their order and isn't parallel).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.operators.counts import missing_words, rekeyed
from kotonami.operators.decode import best_text
from kotonami.operators.ordered import with_previous
from kotonami.plans.engine import Engine
from kotonami.runtime import cut_lineage


def parse_annotated(lines: DataFrame, line: str = "line", key: str = "sent_id") -> DataFrame:
    """(sent_id, i, surface, yomi, start_pos) of lines 'surface/yomi surface/yomi'; comments and blank lines are left out.

    Sentinels at the ends go; a word without a slash is its own reading; a line with an empty
    surface gives nothing. start_pos counts code points of the readings before.
    """
    ends = r"\A(?:__BOS__/\S* )+|(?: __EOS__/\S*)+\z"
    good = lines.where(F.col(line).isNotNull() & (F.trim(line) != "") & ~F.col(line).startswith(";;") & ~F.col(line).rlike("(?:^| )/"))
    words = good.select(F.col(key).alias("sent_id"), F.filter(F.split(F.regexp_replace(line, ends, ""), " ", -1), lambda w: w != "").alias("ws"))
    node = F.transform("ws", lambda w: F.struct(F.substring_index(w, "/", 1).alias("surface"), F.when(w.contains("/"), F.split(w, "/", 2)[1]).otherwise(w).alias("yomi")))
    start = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0), lambda n, x: n + F.length(x["yomi"]))
    nodes = words.select("sent_id", node.alias("n")).withColumn("starts", F.transform("n", lambda x, i: start(F.col("n"), i)))
    rows = nodes.select("sent_id", F.posexplode("n").alias("i", "x"), "starts")
    return rows.select("sent_id", "i", "x.surface", "x.yomi", F.get("starts", F.col("i")).alias("start_pos"))


def sentences(nodes: DataFrame) -> DataFrame:
    """(sent_id, yomi, surface) of annotated nodes."""
    lists = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("i", "surface", "yomi"))).alias("n"))
    join = lambda f: F.array_join(F.transform("n", lambda x: x[f]), "")
    return lists.select("sent_id", join("yomi").alias("yomi"), join("surface").alias("surface"))


def correct_nodes(nodes: DataFrame) -> DataFrame:
    """The distinct words (sent_id, surface, yomi) of annotated sentences."""
    return nodes.select("sent_id", "surface", "yomi").distinct()


def word_gains(nodes: DataFrame, step: int) -> DataFrame:
    """(word, more) of annotated nodes: `step` for every use."""
    return nodes.groupBy(F.concat_ws("/", "surface", "yomi").alias("word")).agg((F.count("*") * step).alias("more"))


def pair_gains(nodes: DataFrame, step: int) -> DataFrame:
    """(w1, w2, more) of neighbours in annotated nodes: `step` for every one."""
    words = nodes.select("sent_id", "i", F.concat_ws("/", "surface", "yomi").alias("word"))
    pairs = with_previous(words, "sent_id", "i", ["word"]).where("prev is not null")
    return pairs.groupBy(F.col("prev.word").alias("w1"), F.col("word").alias("w2")).agg((F.count("*") * step).alias("more"))


def stepped_unigrams(unigram: DataFrame, gains: DataFrame) -> DataFrame:
    """Counts of known words after gains (word, more); other words stay out, and no count is below zero."""
    return unigram.join(gains, "word", "left").select("word", "word_id", F.greatest(F.col("cnt") + F.coalesce("more", F.lit(0)), F.lit(0)).alias("cnt"))


def stepped_bigrams(bigram: DataFrame, unigram: DataFrame, gains: DataFrame) -> DataFrame:
    """Counts of pairs after gains (w1, w2, more) of known words: changed or put in, none below zero."""
    ids = unigram.select("word", "word_id")
    more = gains.join(ids.toDF("w1", "id1"), "w1").join(ids.toDF("w2", "id2"), "w2").select("id1", "id2", "more")
    return bigram.join(more, ["id1", "id2"], "full").select("id1", "id2", F.greatest(F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0)), F.lit(0)).alias("cnt"))


def learn_pass(engine: Engine, teacher: DataFrame, delta: int = 1, sign: int = 1) -> tuple[Engine, int]:
    """The engine after one pass over annotated nodes, and how many sentences were wrong.

    Words and pairs of wrong sentences gain `delta`; with sign=-1 they lose it.
    """
    pairs = sentences(teacher)
    got = best_text(engine.convert(pairs.select("sent_id", "yomi"))).withColumnRenamed("surface", "got")
    wrong = cut_lineage(pairs.join(got, "sent_id", "left").where(~F.col("surface").eqNullSafe(F.col("got"))).select("sent_id"))
    n_wrong = wrong.count()
    if not n_wrong:
        return engine, 0
    nodes = teacher.join(wrong, "sent_id", "left_semi")
    unigram = stepped_unigrams(engine.unigram, word_gains(nodes, delta * sign))
    bigram = stepped_bigrams(engine.bigram, engine.unigram, pair_gains(nodes, delta * sign))
    return replace(engine, unigram=cut_lineage(unigram), bigram=cut_lineage(bigram)), n_wrong


def learn(engine: Engine, corpora: list[tuple[DataFrame, int]], delta: int = 1, sign: int = 1) -> Engine:
    """Train on corpora (annotated nodes, epochs) in order, each for one pass fewer than its epochs, or until all is right.

    Words that the model lacks come in with a count of 1; the totals stay those of the start.
    """
    for nodes, _ in corpora:
        used = nodes.select("sent_id", F.col("i").alias("pos"), F.concat_ws("/", "surface", "yomi").alias("word"))
        engine = replace(engine, unigram=cut_lineage(missing_words(used, engine.unigram)))
    for nodes, epochs in corpora:
        for _ in range(1, epochs):
            engine, wrong = learn_pass(engine, nodes, delta, sign)
            if not wrong:
                break
    return engine


def final_models(engine: Engine, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts under a new numbering of the words."""
    return numbered, rekeyed(engine.bigram, engine.unigram, numbered)
