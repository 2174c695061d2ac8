"""Frequency of every distinct term: a range-partitioned external sort and a run-length scan.

(term, record, occurrence) rows are range-partitioned by term and record and sorted within
partitions by Spark's external sorter, which spills to disk. Equal (term, record) pairs
always share a partition, while a hot term is cut over many partitions at record
boundaries. The scan reads each sorted partition once, batch by batch, in constant memory,
and gives one partial count per term and batch; Spark sums these few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.runtime import is_blank


def _changes(batch: pa.RecordBatch, names: list[str], last: dict | None) -> np.ndarray:
    """True where a row differs from the row before in any of `names`; `last` is the row before the batch."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for name in names:
        col = batch.column(name)
        null = col.is_null().to_numpy(zero_copy_only=False)
        differs = pc.fill_null(pc.not_equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] |= differs | (null[1:] != null[:-1])
        out[0] |= last is None or last[name] != col[0].as_py()
    return out


def scan_runs(batches: Iterator[pa.RecordBatch], occurrence: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial (term, occurrences, n_records) from rows sorted by term, rec and `occurrence`."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new_term = _changes(batch, ["term"], last)
        new_rec = _changes(batch, ["term", "rec"], last)
        new_occ = new_rec | _changes(batch, occurrence, last) if occurrence else np.ones(batch.num_rows, bool)
        starts = np.flatnonzero(new_term | (np.arange(batch.num_rows) == 0))
        weight = batch.column("weight").fill_null(0).to_numpy(zero_copy_only=False)
        yield pa.record_batch(
            {
                "term": batch.column("term").take(pa.array(starts)),
                "occurrences": pa.array(np.add.reduceat(np.where(new_occ, weight, 0), starts), pa.int64()),
                "n_records": pa.array(np.add.reduceat(new_rec.astype(np.int64), starts), pa.int64()),
            }
        )
        last = batch.slice(batch.num_rows - 1).to_pylist()[0]


def term_counts(df: DataFrame, term: Column, record: Column, occurrence: list[Column], weight: Column | None = None) -> DataFrame:
    """(term, occurrences, n_records) of every term in `df`.

    Rows equal in term, record and `occurrence` are one occurrence, which counts `weight`
    (1 if none; a null weight is 0). With no `occurrence` columns every row counts. Null and
    blank terms, and null records, give nothing. Terms are taken exactly as written.
    """
    names = [f"o{i}" for i in range(len(occurrence))]
    rows = df.select(term.alias("term"), record.alias("rec"), *[c.alias(n) for c, n in zip(occurrence, names)], (F.lit(1) if weight is None else weight).cast("bigint").alias("weight"))
    rows = rows.where(F.col("term").isNotNull() & ~is_blank(F.col("term")) & F.col("rec").isNotNull())
    ordered = rows.repartitionByRange("term", "rec").sortWithinPartitions("term", "rec", *names)
    parts = ordered.mapInArrow(lambda batches: scan_runs(batches, names), "term STRING, occurrences BIGINT, n_records BIGINT")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))


def vocabulary_marks(counts: DataFrame, records: DataFrame, common_share: tuple[int, int] = (1, 5), least_records: int = 3, least_occurrences: int = 5) -> DataFrame:
    """`counts` with `mark`: 'common' in more than the share of all records, else 'rare', else null.

    `records` is one row (of column `total`) with the number of all records; an empty table has none.
    """
    part, whole = common_share
    joined = counts.withColumn("one", F.lit(1)).join(F.broadcast(records.select("total", F.lit(1).alias("one"))), "one")
    mark = F.when(F.col("n_records") * whole > F.col("total") * part, "common").when((F.col("n_records") < least_records) | (F.col("occurrences") < least_occurrences), "rare")
    return joined.select("term", "occurrences", "n_records", mark.alias("mark"))


def marked_terms(df: DataFrame, term: str, record: str, occurrence: list[str], weight: str | None = None) -> DataFrame:
    """Counts and marks of every term, out of all records of `df`; rows without a term count as records."""
    counts = term_counts(df, df[term], df[record], [df[o] for o in occurrence], df[weight] if weight else None)
    return vocabulary_marks(counts, df.select(F.count_distinct(df[record]).alias("total")))
