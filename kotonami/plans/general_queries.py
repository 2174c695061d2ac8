"""Queries of the general problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kotonami.operators.badrows import read_records
from kotonami.operators.packed import unpack
from kotonami.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of an entry that holds two or more, with its place."""
    return unpack(table(spark, sf_dir, "dict_entry"), "surfaces", ["entry_id"], least=2).withColumnRenamed("value", "surface")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that can't be loaded, with the first reason."""
    return read_records(table(spark, sf_dir, "dict_line"), "line", ["line_id"]).where("reason is not null").select("line_id", "reason").distinct()


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that can be loaded: its reading, and the candidates joined by slashes."""
    rows = read_records(table(spark, sf_dir, "dict_line"), "line", ["line_id"]).where("reason is null")
    return rows.selectExpr("line_id", "yomi", "array_join(candidates, '/') as surfaces", "hinshi", "cnt").distinct()


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_loaded": p3_loaded}

_LINES = r"""
WITH raw AS (
  SELECT line_id, regexp_replace(line, '\r\z', '') AS l FROM dict_line
  WHERE line IS NOT NULL AND regexp_matches(line, '[^\p{Z}\x09-\x0d\x1c-\x1f\x{85}]') AND NOT starts_with(line, ';;')
), cut AS (
  SELECT line_id, l, regexp_full_match(l, '(?s)([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS quoted,
         regexp_replace(l, '(?s)"([^"]|"")*"', '', 'g') AS bare,
         regexp_extract(l, '(?s)^([^",]*|"(?:[^"]|"")*")(?:,|\z)', 1) AS f1,
         regexp_extract(l, '(?s)^(?:[^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*")(?:,|\z)', 1) AS f2,
         regexp_extract(l, '(?s)^(?:(?:[^",]*|"(?:[^"]|"")*"),){2}([^",]*|"(?:[^"]|"")*")(?:,|\z)', 1) AS f3,
         regexp_extract(l, '(?s)^(?:(?:[^",]*|"(?:[^"]|"")*"),){3}([^",]*|"(?:[^"]|"")*")\z', 1) AS f4 FROM raw
), fields AS (
  SELECT line_id, quoted, len(bare) - len(replace(bare, ',', '')) + 1 AS n,
         CASE WHEN starts_with(f1, '"') THEN replace(f1[2:-2], '""', '"') ELSE f1 END AS yomi,
         CASE WHEN starts_with(f2, '"') THEN replace(f2[2:-2], '""', '"') ELSE f2 END AS surfaces,
         CASE WHEN starts_with(f3, '"') THEN replace(f3[2:-2], '""', '"') ELSE f3 END AS hinshi,
         CASE WHEN starts_with(f4, '"') THEN replace(f4[2:-2], '""', '"') ELSE f4 END AS cnt FROM cut
), items AS (
  SELECT *, list_filter(list_transform(string_split(surfaces, '/')[2:], lambda x: split_part(x, ';', 1)), lambda x: regexp_matches(x, '[^\p{Z}\x09-\x0d\x1c-\x1f\x{85}]')) AS found FROM fields
), judged AS (
  SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 4 THEN 'columns'
    WHEN NOT regexp_matches(yomi, '^[\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30FC}]+[a-z]?\z') THEN 'yomi'
    WHEN len(found) = 0 OR regexp_matches(surfaces, '[\p{Cc}\x{FFFD}]') THEN 'surfaces' END AS reason FROM items
)"""

SQL = {
    "p3_found": _LINES + " SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": _LINES + " SELECT DISTINCT line_id, yomi, array_to_string(found, '/') AS surfaces, hinshi, TRY_CAST(cnt AS BIGINT) AS cnt FROM judged WHERE reason IS NULL",
}
