"""Evaluation of conversions: accuracy and recall by longest common subsequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.functions.text import lcs_length, trim_unicode


def judged_lines(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, yomi, surface, reason) of evaluation lines; comments, null and blank lines are none.

    A line is cut at its first blank, and bars go from both halves. A line without a blank has
    the reason 'no blank' in place of a reading and a surface.
    """
    t = lines.select(*keys, trim_unicode(F.col(line)).alias("t")).where("t <> '' and not startswith(t, '#')")
    half, good = F.split("t", " ", 2), F.col("t").contains(" ")
    bare = lambda c: F.replace(c, F.lit("|"), F.lit(""))
    return t.select(*keys, F.when(good, bare(half[0])).alias("yomi"), F.when(good, bare(F.get(half, F.lit(1)))).alias("surface"), F.when(~good, "no blank").alias("reason"))


def eval_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """(yomi, surface) of evaluation lines; a line without a blank is an error."""
    rows = judged_lines(lines, [], line)
    return rows.select(F.when(F.col("reason").isNull(), F.col("yomi")).otherwise(F.raise_error(F.lit("an evaluation line has no blank"))).alias("yomi"), "surface")


def scores(pairs: DataFrame, expected: str = "surface", got: str = "got") -> DataFrame:
    """One row: good, bad, recall (percent of the system's characters in common subsequences; null without any)."""
    common = pairs.select(F.col(expected).alias("e"), F.coalesce(F.col(got), F.lit("")).alias("g")).withColumn("l", lcs_length(F.col("e"), F.col("g")))
    return common.agg(
        F.count_if(F.col("e") == F.col("g")).alias("good"),
        F.count_if(F.col("e") != F.col("g")).alias("bad"),
        (100.0 * F.sum("l") / F.nullif(F.sum(F.length("g")), F.lit(0))).alias("recall"),
    )
