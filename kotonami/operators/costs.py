"""Additive-smoothed costs of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 1e-5


def smoothed_cost(count: Column, total: Column, unique: Column) -> Column:
    """-log10 of the smoothed probability."""
    return -F.log10((count.cast("double") + ALPHA) / (total.cast("double") + ALPHA + unique.cast("double")))


def totals(counts: DataFrame, count: str = "cnt") -> DataFrame:
    """One row: total_words, unique_words, and the cost of a word or pair that was never seen."""
    sums = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"))
    return sums.withColumn("default_edge_cost", smoothed_cost(F.lit(0), F.col("total_words"), F.col("unique_words")))


def with_costs(counts: DataFrame, stats: DataFrame, count: str = "cnt") -> DataFrame:
    """`counts` with `cost`; the one row of `stats` is broadcast."""
    one = stats.select("total_words", "unique_words", F.lit(1).alias("_one"))
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    return joined.withColumn("cost", smoothed_cost(F.col(count), F.col("total_words"), F.col("unique_words"))).drop("_one", "total_words", "unique_words")
