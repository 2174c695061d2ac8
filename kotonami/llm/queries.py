"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.llm import cooccur, encodings, leakage, lookalike, pii, terms, tokenizer
from kotonami.runtime import BLANK_CLASS, cut_lineage, table

SENTINELS = ("__BOS__", "__EOS__")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of both tables with its occurrences, the records that have it, and its mark."""
    tokens = terms.marked_terms(table(spark, sf_dir, "intermediate_token"), "surface", "sent_id", ["i"])
    users = terms.marked_terms(table(spark, sf_dir, "user_unigram"), "word_key", "user_id", ["save_id", "cnt", "saved_at", "arrived_at"], "cnt")
    named = [d.select(F.lit(n).alias("source_table"), "term", "occurrences", "n_records", "mark") for n, d in (("intermediate_token", tokens), ("user_unigram", users))]
    return named[0].unionByName(named[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common to keep."""
    return p1_terms(spark, sf_dir).where("mark is not null").select("source_table", "term", "mark")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's surface and reading in the dictionary's form."""
    return lookalike.canonical_values(table(spark, sf_dir, "word_node"), ["sent_id", "node_idx"], "surface", "yomi").select("sent_id", "node_idx", "surface_form", F.col("reading_form").alias("yomi_form")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that aren't in the dictionary's form."""
    rows = lookalike.canonical_values(table(spark, sf_dir, "word_node"), ["sent_id", "node_idx"], "surface", "yomi")
    wrong = F.filter(F.array(F.when(F.col("surface") != F.col("surface_form"), "surface"), F.when(F.col("reading") != F.col("reading_form"), "yomi")), lambda x: x.isNotNull())
    return rows.select("sent_id", "node_idx", F.explode(wrong).alias("field_name")).distinct()


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry: whether it is garbled, whether all of it could be recovered, and its candidates after repair."""
    return encodings.repaired_records(table(spark, sf_dir, "dict_decoded"), "decoded_id", "dict_id", "surfaces")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of which a candidate or note is garbled."""
    return p5_records(spark, sf_dir).where("garbled").select("decoded_id").distinct()


def _lattice_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (rec, item), and the number of records."""
    nodes = table(spark, sf_dir, "word_node")
    items = nodes.where(~F.col("auto_generated") & F.col("surface").isNotNull() & ~F.col("surface").isin(*SENTINELS) & F.col("sent_id").isNotNull())
    return cut_lineage(items.select(F.col("sent_id").alias("rec"), F.col("surface").alias("item")).distinct()), nodes.select(F.count_distinct("sent_id").alias("total"))


def _user_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (rec, item_a, item_b), distinct (rec, item), and the number of records."""
    saved = table(spark, sf_dir, "user_bigram")
    words = F.split("word_key", "\t", -1)
    keys = saved.where(F.col("user_id").isNotNull() & (F.size(words) == 2)).select(F.col("user_id").alias("rec"), words[0].alias("x"), words[1].alias("y"))
    pairs = cut_lineage(keys.select("rec", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct())
    items = pairs.select("rec", F.explode(F.array("item_a", "item_b")).alias("item")).distinct()
    return pairs.where("item_a <> item_b"), items, saved.select(F.count_distinct("user_id").alias("total"))


def _named(lattices: DataFrame, users: DataFrame) -> DataFrame:
    return lattices.select(F.lit("word_node").alias("source_table"), "*").unionByName(users.select(F.lit("user_bigram").alias("source_table"), "*"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stand together at least 5 times and 4 times as often as chance, with their counts."""
    items, total = _lattice_items(spark, sf_dir)
    links, own, users = _user_links(spark, sf_dir)
    return _named(cooccur.basket_pairs(items, total), cooccur.keyed_pairs(links, own, users))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p6_counts with their surprise under the fitted null; `surprising` marks those within the false-discovery bound."""
    items, total = _lattice_items(spark, sf_dir)
    links, own, users = _user_links(spark, sf_dir)
    return _named(cooccur.surprise(cooccur.basket_pairs(items, total), items), cooccur.link_surprise(cooccur.keyed_pairs(links, own, users), links))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p6_pairs, surprising or not."""
    return p6_pairs(spark, sf_dir).select("source_table", "item_a", "item_b")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after encoding and streaming decoding; null texts come back empty."""
    return tokenizer.decode_ids(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 30 consecutive letters and digits of a test passage."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "surface")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of personal information, by kind and position."""
    return pii.mentions(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders for personal information."""
    return pii.redacted_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p4_found": p4_found, "p4_values": p4_values, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_counts": p6_counts, "p6_pairs": p6_pairs, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_found": p8_found, "p9_found": p9_found, "p9_redacted": p9_redacted}

_TERMS = rf"""
WITH counts AS (
  SELECT 'intermediate_token' AS source_table, surface AS term, count(DISTINCT (sent_id, i)) AS occurrences, count(DISTINCT sent_id) AS n_records,
         (SELECT count(DISTINCT sent_id) FROM intermediate_token) AS total
  FROM intermediate_token WHERE regexp_matches(surface, '[^{BLANK_CLASS}]') AND sent_id IS NOT NULL GROUP BY surface
  UNION ALL
  SELECT 'user_unigram', word_key, CAST(sum(cnt) AS BIGINT), count(DISTINCT user_id), (SELECT count(DISTINCT user_id) FROM user_unigram)
  FROM (SELECT DISTINCT * FROM user_unigram) WHERE regexp_matches(word_key, '[^{BLANK_CLASS}]') AND user_id IS NOT NULL GROUP BY word_key
), marked AS (
  SELECT source_table, term, occurrences, n_records, CASE WHEN n_records * 5 > total THEN 'common' WHEN n_records < 3 OR occurrences < 5 THEN 'rare' END AS mark FROM counts
)"""

_PAIRS = """
WITH w AS (
  SELECT DISTINCT sent_id AS rec, surface AS item FROM word_node WHERE auto_generated = false AND surface IS NOT NULL AND surface NOT IN ('__BOS__', '__EOS__') AND sent_id IS NOT NULL
), k AS (
  SELECT DISTINCT user_id AS rec, split_part(word_key, chr(9), 1) AS x, split_part(word_key, chr(9), 2) AS y FROM user_bigram WHERE len(word_key) - len(replace(word_key, chr(9), '')) = 1 AND user_id IS NOT NULL
), u AS (
  SELECT rec, x AS item FROM k UNION SELECT rec, y FROM k
), wn AS (SELECT item, count(*) AS n FROM w GROUP BY item), un AS (SELECT item, count(*) AS n FROM u GROUP BY item),
wt AS (SELECT count(DISTINCT sent_id) AS total FROM word_node), ut AS (SELECT count(DISTINCT user_id) AS total FROM user_bigram),
wk AS (SELECT w.rec, w.item FROM w JOIN wn USING (item), wt WHERE wn.n >= 5 AND wn.n * 4 <= wt.total),
wp AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM wk a JOIN wk b ON a.rec = b.rec AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
up AS (SELECT least(x, y) AS item_a, greatest(x, y) AS item_b, count(DISTINCT rec) AS n_ab FROM k WHERE x <> y GROUP BY 1, 2 HAVING count(DISTINCT rec) >= 5),
named AS (
  SELECT 'word_node' AS source_table, item_a, item_b, n_ab, p.n AS n_a, q.n AS n_b, total FROM wp JOIN wn p ON p.item = item_a JOIN wn q ON q.item = item_b, wt WHERE n_ab * total >= 4 * p.n * q.n
  UNION ALL
  SELECT 'user_bigram', item_a, item_b, n_ab, p.n, q.n, total FROM up JOIN un p ON p.item = item_a JOIN un q ON q.item = item_b, ut WHERE n_ab * total >= 4 * p.n * q.n)"""

SQL = {
    "p1_found": _TERMS + " SELECT source_table, term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + " SELECT * FROM marked",
    "p6_found": _PAIRS + " SELECT source_table, item_a, item_b FROM named",
    "p6_counts": _PAIRS + " SELECT * FROM named",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
