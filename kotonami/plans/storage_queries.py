"""Queries that write what the engine keeps and read it again, and those of users and sessions; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions.text import choice
from kotonami.operators import counts, lattice
from kotonami.operators.costs import totals
from kotonami.plans import conversion_queries as conversion
from kotonami.plans import reference_queries as base
from kotonami.plans import text_queries
from kotonami.runtime import Folder, cut_lineage, ensure_checkpoint_dir, table
from kotonami.sources import sinks
from kotonami.sources.readers import read_skk
from kotonami.streaming import session, userdata

#: Parameters of the raising rule that ends at a missing word.
RAISED_UNTIL = [("を/を", "の/の"), ("無い語/ないご", "は/は"), ("と/と", "は/は")]


def _kept(spark: SparkSession, work: Callable[[str], DataFrame]) -> DataFrame:
    """What `work` reads from a folder of its own in the shared folder, which goes afterwards."""
    at = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    try:
        return cut_lineage(work(at))
    finally:
        Folder(spark, at).delete()


def wfreq_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts above 16, from a written list."""

    def work(at: str) -> DataFrame:
        sinks.write_wfreq(base.wfreq(spark, sf_dir), at)
        return sinks.read_wfreq(spark, at, counts.UNIGRAM_CUT)

    return _kept(spark, work)


def vocab_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary, from a written list."""

    def work(at: str) -> DataFrame:
        sinks.write_vocab(counts.vocabulary(base.wfreq(spark, sf_dir)), at)
        return spark.read.text(at).withColumnRenamed("value", "word")

    return _kept(spark, work)


def skk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system dictionary, from a written dictionary file; readings with a blank or a Latin beginning can't stand in one."""

    def work(at: str) -> DataFrame:
        system = conversion._system(spark, sf_dir, counts.vocabulary(base.wfreq(spark, sf_dir)))
        sinks.write_skk(system.where(~F.col("yomi").contains(" ")), at)
        return read_skk(spark, at).select("yomi", F.array_join("surfaces", "/").alias("surfaces"))

    return _kept(spark, work)


def model_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words with their counts and the totals of the words, all from a written model folder."""

    def work(at: str) -> DataFrame:
        vocab, pairs = conversion._models(spark, sf_dir)
        sinks.write_model(at, vocab, pairs, totals(vocab))
        unigram, bigram, stats = sinks.read_model(spark, at)
        one = F.lit(1).alias("_one")
        rows = counts.with_words(bigram, unigram).select("word1", "word2", "cnt", one).join(F.broadcast(stats.select("total_words", "unique_words", one)), "_one")
        return rows.drop("_one")

    return _kept(spark, work)


def tokens_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the words of written corpus lines."""

    def work(at: str) -> DataFrame:
        sinks.write_tokens(base.token_merge(spark, sf_dir).withColumn("sent_id", F.concat_ws("-", "sent_id", F.floor(F.col("run") / 16))), at)
        return counts.word_frequencies(counts.words_of_lines(spark.read.text(at), "value"))

    return _kept(spark, work)


def user_stats_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' counts from a written statistics file; keys with a blank can't stand in one."""

    def work(at: str) -> DataFrame:
        sinks.write_user_stats(conversion._user_counts(spark, sf_dir, "user_unigram").where(~F.col("key").contains(" ")), at)
        return userdata.read_stats(spark, at)

    return _kept(spark, work)


def tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of morphemes in the folder of each source that they were written to."""

    def work(at: str) -> DataFrame:
        sinks.write_by_source(table(spark, sf_dir, "intermediate_token").select("sent_id", "i", "src_path"), "src_path", at)
        return spark.read.parquet(at).groupBy("source_key").agg(F.count("*").alias("n"))

    return _kept(spark, work)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sentences as commits of their words, in parts of 16 morphemes."""
    w = F.split("word", "/", 2)
    return base.token_merge(spark, sf_dir).select((F.col("sent_id") * 100_000 + F.floor(F.col("run") / 16)).alias("commit_id"), F.col("run").alias("i"), w[0].alias("surface"), w[1].alias("yomi"), F.lit(False).alias("compound_word"))


def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of neighbours of all commits with their counts."""
    commits = cut_lineage(_commits(spark, sf_dir))
    return userdata.unigram_counts(commits).unionByName(userdata.bigram_counts(commits))


def commits_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all commits after they were recorded into a store in three batches, one of them twice."""
    commits = cut_lineage(_commits(spark, sf_dir))

    def work(at: str) -> DataFrame:
        store = userdata.UserStore(at)
        for n in (0, 1, 1, 2):
            store.record(commits.where(F.pmod("commit_id", F.lit(3)) == n), n)
        store.compact(spark)
        return store.read(spark, "unigram")

    return _kept(spark, work)


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that the users' statistics and the single-term dictionaries know."""
    return userdata.user_keys(conversion._user_counts(spark, sf_dir, "user_unigram"), conversion._of_usage(spark, sf_dir, "SingleTerm"))


def dictionary_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured dictionaries in their standard spelling; an unknown value is an error."""
    plain = F.regexp_replace(F.lower(F.coalesce("encoding", F.lit("utf8"))), "[^a-z0-9]", "")
    return table(spark, sf_dir, "dict_config").select("dict_id", choice(plain, ["utf8", "eucjp"]).alias("encoding"), choice(F.upper(F.trim("dict_type")), ["SKK"]).alias("dict_type"), choice(F.col("usage"), ["Normal", "SingleTerm", "Disabled"]).alias("usage"))


def forced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the test readings where the third to fifth characters are forced to be one."""
    forced = F.when(F.length("yomi") >= 5, F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"))))
    readings = table(spark, sf_dir, "eval_item").select(F.col("item_id").cast("bigint").alias("sent_id"), "yomi", forced.alias("force_ranges"))
    return lattice.segments(readings, base.dictionary_keys(spark, sf_dir))


def score_rules_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts after the raising rule, which ends at the first pair with a missing word."""
    return counts.raised_scores(base.wfreq(spark, sf_dir), RAISED_UNTIL, stop_at_missing=True)


def live_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First conversions of the test sentences as a stream of inputs in three batches."""
    engine = conversion._engine(spark, sf_dir)
    inputs = cut_lineage(conversion._sentences(spark, sf_dir).select("sent_id", F.col("yomi").alias("raw_input")))

    def work(at: str) -> DataFrame:
        for n in range(3):
            inputs.where(F.pmod("sent_id", F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(inputs.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        session.live_stream(engine, stream, at).awaitTermination()
        return spark.read.parquet(f"{at}/texts").select("sent_id", "surface")

    return _kept(spark, work)


def sessions_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions commit in which every typed input of the documents is keyed in and committed as it stands."""
    typed = text_queries._inputs(spark, sf_dir)
    keys = typed.select(F.col("typed").alias("session_id"), F.posexplode(F.array_append(F.filter(F.split("typed", ""), lambda x: x != ""), F.lit("Return"))).alias("seq", "char"))
    events = keys.select("session_id", "seq", F.when(F.col("char") == "Return", "commit_preedit").alias("command"), "char", F.lit(False).alias("modified"))
    return session.run_sessions(events, session.by_dictionary({})).select(F.col("session_id").alias("typed"), "text")


QUERIES = {f.__name__: f for f in (
    wfreq_stored, vocab_stored, skk_stored, model_stored, tokens_stored, user_stats_stored, tokens_by_source, commit_counts, commits_recorded, user_readings, dictionary_configs, forced_segments, score_rules_ended, live_conversion, sessions_committed,
)}

_G = base._GAINS.format("user_unigram")
_COMMITS = "cm AS (SELECT sent_id * 100000 + run // 16 AS id, run, word FROM merge)"

SQL = {
    "wfreq_stored": f"WITH {base._MERGE} SELECT word, cnt FROM freq WHERE cnt > 16",
    "vocab_stored": f"WITH {base._MERGE} SELECT word FROM kept",
    "skk_stored": f"WITH {base._MERGE}, {conversion._LINES_CTE}, {conversion._SYSTEM} SELECT yomi, array_to_string(surfaces, '/') AS surfaces FROM sysdict WHERE NOT contains(yomi, ' ') AND NOT regexp_matches(yomi, '^[A-Za-z]')",
    "model_stored": f"WITH {base._BIGRAMS} SELECT word1, word2, cnt, coalesce(t, 0) AS total_words, u AS unique_words FROM big, stats",
    "tokens_stored": text_queries.SQL["words_of_corpus_lines"],
    "user_stats_stored": f"SELECT word_key AS key, cnt FROM {_G} g WHERE NOT contains(word_key, ' ')",
    "tokens_by_source": "SELECT regexp_replace(src_path, '[^A-Za-z0-9_.-]', '_', 'g') AS source_key, count(*) AS n FROM intermediate_token GROUP BY 1",
    "commit_counts": f"WITH {base._MERGE}, {_COMMITS} SELECT word AS key, count(*) AS cnt FROM cm GROUP BY 1 UNION ALL SELECT key, count(*) FROM (SELECT lag(word) OVER (PARTITION BY id ORDER BY run) || chr(9) || word AS key FROM cm) WHERE key IS NOT NULL GROUP BY 1",
    "commits_recorded": f"WITH {base._MERGE}, {_COMMITS} SELECT word AS key, count(*) AS cnt FROM cm GROUP BY 1",
    "user_readings": f"WITH {conversion._USAGE} SELECT DISTINCT substr(word_key, strpos(word_key, '/') + 1) AS yomi FROM {_G} g WHERE contains(word_key, '/') UNION SELECT yomi FROM udict WHERE usage = 'SingleTerm'",
    "dictionary_configs": "SELECT dict_id, regexp_replace(lower(coalesce(encoding, 'utf8')), '[^a-z0-9]', '', 'g') AS encoding, upper(trim(dict_type)) AS dict_type, usage FROM dict_config",
    "forced_segments": f"""WITH RECURSIVE {base._SEGMENTS.replace(
        "steps AS (", "nosteps AS (", 1).replace("), reach AS (", '''), steps AS (
  SELECT s.sent_id, s.p, s.e FROM nosteps s JOIN texts USING (sent_id) JOIN num USING (sent_id, p) WHERE len(r) < 5 OR (p NOT IN (2, 3, 4) AND (n <> '' OR e NOT BETWEEN 2 AND 5))
  UNION SELECT sent_id, 2, 5 FROM texts WHERE len(r) >= 5
  UNION SELECT num.sent_id, p, p + 1 FROM num JOIN texts USING (sent_id) WHERE len(r) >= 5 AND n = '' AND p NOT IN (2, 3, 4) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.sent_id = num.sent_id AND h.p = num.p AND h.e NOT BETWEEN 2 AND 5)
), reach AS (''', 1)} SELECT * FROM segs""",
    "score_rules_ended": f"WITH {base._MERGE} SELECT word, greatest(cnt, CASE WHEN word = '{RAISED_UNTIL[0][0]}' THEN coalesce((SELECT max(o.cnt + 1) FROM freq o WHERE o.word = '{RAISED_UNTIL[0][1]}'), cnt) ELSE cnt END) AS cnt FROM freq",
    "live_conversion": conversion.SQL["eval_converted"],
    "sessions_committed": f"WITH RECURSIVE {text_queries._TYPED}, {text_queries._KEYS}, {text_queries._ROMAJI} SELECT typed, CASE WHEN regexp_matches(typed, '^[A-Z]') THEN typed ELSE kana END AS text FROM kana",
}
