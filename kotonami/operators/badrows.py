"""Rows that fail to parse: load the valid ones, set the others aside with the reason.

Records are read permissively under an explicit schema that keeps the raw text of
corrupt ones; whatever the reader calls corrupt, and whatever it silently mends, is
classified again by quoting, column count and the checks of each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.runtime import BLANK_CLASS, is_blank

#: The record: yomi, surfaces, hinshi, cnt; and the raw text of a record that can't be read so.
RECORD_SCHEMA = "yomi STRING, surfaces STRING, hinshi STRING, cnt BIGINT, corrupt STRING"
COLUMNS = 4
YOMI_PATTERN = r"^[\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30FC}]+[a-z]?\z"
UNCLEAN_PATTERN = r"[\p{Cc}\x{FFFD}]"
#: A noncharacter, which text can't hold, stands for the separators outside quotes.
SPLIT_MARK = chr(0xFDD0)


def _outside(parts: Column) -> Column:
    """Pieces outside quotes when a record is cut at every mark of quotation."""
    return F.filter(parts, lambda x, i: i % 2 == 0)


def quoting_fails(parts: Column) -> Column:
    """True where marks don't pair up, or stand other than around a whole field.

    Pieces at even places are outside quotes. The one between two marks in a row is
    empty (a doubled mark); any other must end a field on each side that touches a mark.
    """
    last = F.size(parts) - 1
    wrong = F.filter(
        parts,
        lambda x, i: (i % 2 == 0) & (x != "") & (((i > 0) & ~x.startswith(",")) | ((i < last) & ~x.endswith(","))),
    )
    return (last % 2 == 1) | (F.size(wrong) > 0)


def own_fields(parts: Column) -> Column:
    """array<string>: the fields of a record whose quoting holds, without marks of quotation."""
    last = F.size(parts) - 1
    plain = F.transform(
        parts,
        lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit(SPLIT_MARK))),
    )
    return F.split(F.array_join(plain, ""), SPLIT_MARK, -1)


def candidates(surfaces: Column) -> Column:
    """Non-blank candidates between slashes, notes from `;` on dropped; the final slash may be missing."""
    items = F.when(surfaces.contains("/"), F.split(F.regexp_replace(surfaces, r"\A[^/]*/", ""), "/", -1)).otherwise(F.array().cast("array<string>"))
    bare = F.transform(items, lambda x: F.substring_index(x, ";", 1))
    return F.filter(bare, lambda x: ~is_blank(x))


#: A slash, and behind it, before any note or slash, a character that isn't blank.
CANDIDATE_PATTERN = rf"/[^;/]*[^;/{BLANK_CLASS}]"


def read_records(df: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """(keys, raw, yomi, candidates, hinshi, cnt, reason) of every record in `line`.

    Null, blank and `;;` lines are no records. `reason` is null for a valid record, else
    the first of 'quoting', 'columns', 'yomi', 'surfaces'; the fields of a failed record are
    null. A count that isn't a whole number is null and no failure. A carriage return at
    the end isn't part of the record. Other columns of `df` are left out.
    """
    ks = [F.col(f"k{i}") for i in range(len(keys))]
    raw = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], df[line].alias("line"))
    raw = raw.where(F.col("line").isNotNull() & ~is_blank(F.col("line")) & ~F.col("line").startswith(";;"))
    raw = raw.select(*ks, F.regexp_replace("line", r"\r\z", "").alias("raw"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "sep": ",", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
    read = raw.select(*ks, "raw", F.from_csv("raw", RECORD_SCHEMA, options).alias("r"), F.split("raw", '"', -1).alias("parts"))
    commas = F.when(F.col("raw").contains('"'), F.array_join(_outside(F.col("parts")), "")).otherwise(F.col("raw"))
    again = F.col("r.corrupt").isNotNull() | F.col("r.yomi").isNull() | F.col("r.surfaces").isNull() | F.col("raw").rlike(UNCLEAN_PATTERN)
    read = read.select(
        *ks,
        "raw",
        "r",
        F.when(F.col("raw").contains('"'), quoting_fails(F.col("parts"))).otherwise(False).alias("bad_quoting"),
        (F.length(commas) - F.length(F.replace(commas, F.lit(","), F.lit(""))) + 1).alias("n_columns"),
        F.when(again, own_fields(F.col("parts"))).alias("own"),
    )
    field = lambda i, name: F.when(F.col("own").isNotNull(), F.get("own", F.lit(i))).otherwise(F.col(f"r.{name}"))
    read = read.select(*ks, "raw", "bad_quoting", "n_columns", field(0, "yomi").alias("y"), field(1, "surfaces").alias("s"), field(2, "hinshi").alias("h"), F.coalesce(F.col("r.cnt"), F.get("own", F.lit(3)).try_cast("bigint")).alias("c"))
    reason = (
        F.when(F.col("bad_quoting"), "quoting")
        .when(F.col("n_columns") != COLUMNS, "columns")
        .when(~F.coalesce(F.col("y"), F.lit("")).rlike(YOMI_PATTERN), "yomi")
        .when(F.coalesce(F.col("s"), F.lit("")).rlike(UNCLEAN_PATTERN) | ~F.coalesce(F.col("s"), F.lit("")).rlike(CANDIDATE_PATTERN), "surfaces")
    )
    read = read.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return read.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        "raw",
        F.when(ok, F.col("y")).alias("yomi"),
        F.when(ok, candidates(F.col("s"))).alias("candidates"),
        F.when(ok, F.col("h")).alias("hinshi"),
        F.when(ok, F.col("c")).alias("cnt"),
        "reason",
    )
