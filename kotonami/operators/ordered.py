"""Running values along long ordered groups, in two levels, so that a crowded group isn't one task.

Where the largest group is small enough for one task, a plain window does, and needs no more
than one shuffle. Beyond that, rows of a group are cut into chunks of order values: windows run
within chunks, and one summary row a chunk carries what the next chunks need. Ranks over a whole table come from range
partitions with offsets, not from one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonami.runtime import cut_lineage

CHUNK = 4096
#: A group of no more rows than this is one task's work.
WINDOW_ROWS = 200_000


def is_crowded(df: DataFrame, group: str) -> bool:
    """Whether some group is too large for a plain window; one pass, combined before its shuffle."""
    largest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) > WINDOW_ROWS


def distinct_by_group(df: DataFrame, group: str, crowded: bool) -> DataFrame:
    """Distinct rows; already where the group's windows need them, unless a group is crowded."""
    return df.distinct() if crowded else df.repartition(group).distinct()


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / chunk))


def with_previous(df: DataFrame, group: str, order: str, columns: list[str], crowded: bool | None = None, chunk: int = CHUNK) -> DataFrame:
    """`df` with struct `prev` of `columns` of the row before in the group, null for the first.

    Order values are numbers, unique within the group. `crowded` is found by counting where it isn't given.
    """
    if not (is_crowded(df, group) if crowded is None else crowded):
        return df.withColumn("prev", F.lag(F.struct(*columns)).over(Window.partitionBy(group).orderBy(order)))
    cut = _chunked(df, order, chunk)
    inner = Window.partitionBy(group, "_chunk").orderBy(order)
    mine = cut.withColumn("_in", F.lag(F.struct(*columns)).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    ends = cut.groupBy(group, "_chunk").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    carry = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group).orderBy("_chunk"))).select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), "_carry")
    joined = mine.join(carry, mine[group].eqNullSafe(carry["_g"]) & (mine["_chunk"] == carry["_c"]), "left")
    return joined.withColumn("prev", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))).drop("_chunk", "_in", "_first", "_g", "_c", "_carry")


def running(df: DataFrame, group: str, order: str, value: Column, name: str, how: str = "sum", before: bool = False, crowded: bool | None = None, chunk: int = CHUNK) -> DataFrame:
    """`df` with the running `how` ('sum' or 'max') of `value` along the group; `before` leaves the row itself out."""
    fold = F.sum if how == "sum" else F.max
    if not (is_crowded(df, group) if crowded is None else crowded):
        run = fold(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
        return df.withColumn(name, F.coalesce(run, F.lit(0)) if how == "sum" else run)
    cut = _chunked(df.withColumn("_v", value), order, chunk)
    inner = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    mine = cut.withColumn("_in", fold("_v").over(inner))
    ends = cut.groupBy(group, "_chunk").agg(fold("_v").alias("_last"))
    outer = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), fold("_last").over(outer).alias("_carry"))
    joined = mine.join(carry, mine[group].eqNullSafe(carry["_g"]) & (mine["_chunk"] == carry["_c"]), "left")
    both = F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0)) if how == "sum" else F.greatest("_in", "_carry")
    return joined.withColumn(name, both).drop("_v", "_chunk", "_in", "_last", "_g", "_c", "_carry")


def ranked(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with consecutive numbers along `order`, by range partitions and their offsets."""
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    offsets = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_offset"))
    mine = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return mine.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_k") - 1 + F.coalesce("_offset", F.lit(0)) + start).cast("int")).drop("_part", "_p", "_k", "_offset")
