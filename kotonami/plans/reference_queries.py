"""Queries of the conversion pipeline over the given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions.romaji import VOWELS, default_table
from kotonami.functions.text import DIGITS, GROUPS, PLACES, kansuji
from kotonami.operators import counts, dictionary, lattice, morph
from kotonami.operators.badrows import read_records
from kotonami.operators.costs import totals, with_costs
from kotonami.operators.ordered import distinct_by_group, is_crowded, running
from kotonami.runtime import Folder, cut_lineage, ensure_checkpoint_dir, table
from kotonami.sources.readers import novel_lines, wiki_lines
from kotonami.streaming import userdata

#: Parameters of the score rules: words whose counts are copied or raised.
COPIED = [("の/の", "乃/の"), ("から/から", "空/から")]
RAISED = [("を/を", "の/の"), ("と/と", "は/は"), ("無い語/ないご", "は/は")]


# -- corpus to models ----------------------------------------------------------------------


def token_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes merged to words."""
    return morph.merge_tokens(table(spark, sf_dir, "intermediate_token"))


def kana_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes with the surface that a kana-preferring corpus has."""
    t = table(spark, sf_dir, "intermediate_token").where("surface is not null and yomi is not null")
    return t.select("sent_id", "i", morph.prefer_kana(F.col("surface"), F.col("yomi"), F.col("hinshi"), F.col("subhinshi"), True).alias("surface")).distinct()


def start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each morpheme's reading begins in its sentence, in code points and in bytes."""
    t = table(spark, sf_dir, "intermediate_token").where("surface is not null and yomi is not null").select("sent_id", "i", "yomi")
    crowded = is_crowded(t, "sent_id")
    chars = running(distinct_by_group(t, "sent_id", crowded), "sent_id", "i", F.length("yomi"), "start_pos", before=True, crowded=crowded)
    return running(chars, "sent_id", "i", F.octet_length("yomi"), "start_byte", before=True, crowded=crowded).select("sent_id", "i", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("start_byte").cast("bigint").alias("start_byte"))


def _frequencies(merged: DataFrame) -> DataFrame:
    return counts.word_frequencies(merged.where(counts.countable(F.col("word"))))


def wfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word occurs."""
    return _frequencies(token_merge(spark, sf_dir))


def _vocab(spark: SparkSession, sf_dir: str, threshold: int = counts.UNIGRAM_CUT, merged: DataFrame | None = None) -> DataFrame:
    return counts.numbered(counts.vocabulary(wfreq(spark, sf_dir) if merged is None else _frequencies(merged), threshold))


def unigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with ids, counts and costs."""
    vocab = _vocab(spark, sf_dir)
    return with_costs(vocab, totals(vocab)).select("word", "word_id", "cnt", F.round("cost", 6).alias("cost"))


def model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the unigram counts and the cost of an unseen word."""
    return totals(counts.vocabulary(wfreq(spark, sf_dir))).select("total_words", "unique_words", F.round("default_edge_cost", 6).alias("default_edge_cost"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged corpus, written: counts of words and of pairs both read it."""
    return cut_lineage(token_merge(spark, sf_dir))


def _bigrams(merged: DataFrame, vocab: DataFrame, threshold: int = 0) -> DataFrame:
    return counts.bigram_counts(merged.withColumnRenamed("run", "pos"), vocab, threshold)


def bigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and costs of neighbours in the vocabulary."""
    merged = _merged(spark, sf_dir)
    pairs = cut_lineage(_bigrams(merged, _vocab(spark, sf_dir, merged=merged)))
    return with_costs(pairs, totals(pairs)).select("id1", "id2", "cnt", F.round("cost", 6).alias("cost"))


def bigram_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent neighbours by word."""
    merged = _merged(spark, sf_dir)
    vocab = _vocab(spark, sf_dir, merged=merged)
    return counts.with_words(_bigrams(merged, vocab, counts.UNIGRAM_CUT), vocab).select("cnt", "word1", "word2")


def bigram_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts under the ids of a smaller vocabulary."""
    merged = _merged(spark, sf_dir)
    vocab, small = _vocab(spark, sf_dir, merged=merged), _vocab(spark, sf_dir, 40, merged)
    return counts.rekeyed(_bigrams(merged, vocab), vocab, small)


def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with the words that only users' statistics have."""
    used = table(spark, sf_dir, "user_unigram").where("word_key is not null").select(F.col("user_id").alias("sent_id"), F.col("save_id").alias("pos"), F.col("word_key").alias("word"))
    return counts.missing_words(used, _vocab(spark, sf_dir))


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts after the copying and raising rules."""
    return counts.raised_scores(counts.homograph_copies(wfreq(spark, sf_dir), COPIED), RAISED)


# -- text sources --------------------------------------------------------------------------


def wiki_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the wiki documents that are text."""
    lines = table(spark, sf_dir, "documents").where("startswith(source, 'wiki/')").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return wiki_lines(lines)


def novel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the novels without notes and ruby."""
    files = table(spark, sf_dir, "documents").where("startswith(source, 'novel/')").select(F.col("doc_id").cast("string").alias("path"), "text")
    return novel_lines(files)


# -- dictionaries --------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dict_decoded").where("surfaces is not null").select("dict_id", "yomi", "decoded_id", dictionary.entry_surfaces(F.col("surfaces")).alias("surfaces"))
    return dictionary.last_entries(rows, ["dict_id", "yomi"], "decoded_id")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.merged(dictionary.to_rows(_entries(spark, sf_dir).withColumnRenamed("dict_id", "src_rank"), "src_rank"))


def dictionary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dictionaries merged in order."""
    return _dictionary(spark, sf_dir).select("yomi", F.array_join("surfaces", "/").alias("surfaces"))


def dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of the dictionaries."""
    return table(spark, sf_dir, "dict_decoded").where("yomi is not null").select("yomi").distinct()


def dictionary_okuri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with an okuri letter, spelled out."""
    good = read_records(table(spark, sf_dir, "dict_line"), "line", ["line_id"]).where("reason is null")
    rows = good.select("line_id", "yomi", F.col("candidates").alias("surfaces")).where(F.col("yomi").rlike("[a-z]$"))
    return dictionary.expand_okuri(rows).select("line_id", "yomi", F.array_join("surfaces", "/").alias("surfaces")).distinct()


def dictionary_of_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the vocabulary with their words in order."""
    return dictionary.grouped(dictionary.from_vocabulary(counts.vocabulary(wfreq(spark, sf_dir))), ["word"]).select("yomi", F.array_join("surfaces", "/").alias("surfaces"))


def dictionary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a system dictionary must not hold."""
    raw = table(spark, sf_dir, "dict_entry").where("yomi is not null").select("yomi", F.split(F.coalesce("surfaces", F.lit("")), "[/／]", -1).alias("surfaces"))
    return dictionary.violations(raw).distinct()


def dictionary_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dictionary reading that stands somewhere in a test reading."""
    readings = table(spark, sf_dir, "eval_item").select("item_id", F.col("yomi").alias("reading"))
    return dictionary.prefix_hits(readings, dictionary_keys(spark, sf_dir)).select("item_id", "start_pos", F.col("key").alias("yomi"))


def dictionary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first readings that continue a prefix: a report of ten."""
    return dictionary.predictive_hits(table(spark, sf_dir, "dict_decoded"), "かい", 10)


def dictionary_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dictionary reading that continues the reading of a lattice node."""
    return dictionary.continuations(table(spark, sf_dir, "dict_decoded"), table(spark, sf_dir, "word_node"), "yomi")


# -- lattices ------------------------------------------------------------------------------


def eval_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the test readings."""
    readings = table(spark, sf_dir, "eval_item").select(F.col("item_id").cast("bigint").alias("sent_id"), "yomi")
    return lattice.segments(readings, dictionary_keys(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "word_node").where("surface is not null and yomi is not null").distinct()


def _user_costs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return userdata.user_costs(userdata.summed_gains(table(spark, sf_dir, name)))


def span_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each span of a lattice."""
    return lattice.same_span(_nodes(spark, sf_dir)).select("sent_id", "start_pos", "end_pos", F.array_join("surfaces", "|").alias("surfaces"))


# -- users ---------------------------------------------------------------------------------


def user_unigram_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counts and costs of words over all users."""
    return _user_costs(spark, sf_dir, "user_unigram").select("word_key", "cnt", F.round("cost", 6).alias("cost"))


def user_bigram_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counts and costs of word pairs over all users."""
    return _user_costs(spark, sf_dir, "user_bigram").select("word_key", "cnt", F.round("cost", 6).alias("cost"))


def streaming_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counts as a stream of six batches in order of arrival, late rows among them; each batch writes the keys that it changes."""
    at = f"{ensure_checkpoint_dir(spark)}/user-counts-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "user_unigram")
    userdata.staged(rows, "arrived_at", 6, f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    userdata.stream_into_table(userdata.stream_counts(stream), at).awaitTermination()
    result = cut_lineage(userdata.current_counts(spark, at))
    Folder(spark, at).delete()
    return result


# -- scalar functions over table values ----------------------------------------------------


def kansuji_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the corpus in kanji: every numeral that a BIGINT holds."""
    t = table(spark, sf_dir, "intermediate_token").where(F.col("surface").rlike(r"^[0-9]+\z") & F.col("surface").try_cast("bigint").isNotNull()).select("surface").distinct()
    return t.select("surface", kansuji(F.col("surface").try_cast("bigint")).alias("kanji"))


def bigram_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair model by word: cost and both words."""
    merged = _merged(spark, sf_dir)
    vocab = _vocab(spark, sf_dir, merged=merged)
    pairs = cut_lineage(_bigrams(merged, vocab))
    return counts.with_words(with_costs(pairs, totals(pairs)), vocab).select(F.round("cost", 6).alias("cost"), "word1", "word2")


QUERIES = {f.__name__: f for f in (
    token_merge, kana_preferred, start_offsets, wfreq, unigram_model, model_totals, bigram_model, bigram_words, bigram_rekeyed, new_words, score_rules, wiki_text, novel_text,
    dictionary_merged, dictionary_keys, dictionary_okuri, dictionary_of_vocabulary, dictionary_violations, dictionary_prefixes, dictionary_predictions, dictionary_continuations, eval_segments,
    span_alternatives, user_unigram_costs, user_bigram_costs, streaming_user_counts, kansuji_numbers, bigram_dump,
)}

# -- SQL -----------------------------------------------------------------------------------

_MERGE = r"""
tok AS (SELECT DISTINCT sent_id, i, surface, coalesce(yomi, surface) AS yomi, hinshi, subhinshi, subsubhinshi FROM intermediate_token WHERE surface IS NOT NULL AND regexp_matches(surface, '[^\p{Z}\x09-\x0d]')),
lagged AS (SELECT *, lag(i) OVER w AS pi, lag(hinshi) OVER w AS ph, lag(subsubhinshi) OVER w AS ps FROM tok WINDOW w AS (PARTITION BY sent_id ORDER BY i)),
joined AS (SELECT *, pi IS NOT NULL AND (coalesce(hinshi = '助動詞' AND ph IN ('動詞', '助動詞'), false) OR coalesce(subhinshi IN ('接続助詞', '接尾'), false)) AS j FROM lagged),
runs AS (SELECT sent_id, i, surface, CASE WHEN j AND surface IN ('家', 'か') AND ps = '人名' THEN 'け' ELSE yomi END AS yomi, max(CASE WHEN NOT j THEN i END) OVER (PARTITION BY sent_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM joined),
merge AS (SELECT sent_id, run, string_agg(surface, '' ORDER BY i) || '/' || string_agg(yomi, '' ORDER BY i) AS word FROM runs GROUP BY sent_id, run),
freq AS (SELECT word, count(*) AS cnt FROM merge WHERE word <> '' AND strpos(word, chr(8207)) = 0 AND NOT starts_with(word, '/') AND NOT starts_with(word, ' ') GROUP BY word
  HAVING NOT regexp_matches(word, '^[\x{30A0}-\x{30FF}]{2}/[\x{3040}-\x{309F}]{2}$')),
kept AS (SELECT * FROM freq WHERE cnt > 16 AND strpos(word, '/') > 0 AND NOT starts_with(trim(word, ' '), '//')),
vocab AS (SELECT word, cnt, CAST(row_number() OVER (ORDER BY encode(word)) - 1 AS INT) AS word_id FROM kept),
stats AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM kept)"""

_BIGRAMS = _MERGE + """,
pairs AS (SELECT lag(word) OVER (PARTITION BY sent_id ORDER BY run) AS w1, word AS w2 FROM merge),
big AS (SELECT a.word_id AS id1, b.word_id AS id2, a.word AS word1, b.word AS word2, count(*) AS cnt FROM pairs JOIN vocab a ON a.word = w1 JOIN vocab b ON b.word = w2 GROUP BY ALL),
bstats AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM big)"""


def _cost(n: str, t: str = "t", u: str = "u") -> str:
    return f"(-log10(({n} + 1e-5) / ({t} + 1e-5 + {u})))"


_DICT = """
parts AS (SELECT dict_id, yomi, decoded_id, list_filter(list_transform(string_split(regexp_replace(surfaces, '^/+|/+$', '', 'g'), '/'), lambda x: split_part(x, ';', 1)), lambda x: x <> '') AS s FROM dict_decoded WHERE surfaces IS NOT NULL),
lasts AS (SELECT dict_id, yomi, arg_max(s, decoded_id) AS s FROM parts WHERE yomi IS NOT NULL GROUP BY dict_id, yomi),
flat AS (SELECT dict_id, yomi, unnest(s) AS surface, unnest(range(len(s))) AS pos FROM lasts),
firsts AS (SELECT yomi, surface, min((dict_id, pos)) AS place FROM flat GROUP BY yomi, surface),
dict AS (SELECT yomi, list(surface ORDER BY place, surface) AS surfaces FROM firsts GROUP BY yomi),
keys AS (SELECT DISTINCT yomi FROM dict_decoded WHERE yomi IS NOT NULL)"""

_SEGMENTS = _DICT + r""",
texts AS (SELECT CAST(item_id AS BIGINT) AS sent_id, yomi AS r FROM eval_item WHERE yomi <> ''),
places AS (SELECT sent_id, r, unnest(range(len(r))) AS p FROM texts),
num AS (SELECT sent_id, p, regexp_extract(r[p + 1:], '^(?:0|[1-9][0-9]*)(?:\.[0-9]*)?') AS n FROM places),
longest AS (SELECT max(len(yomi)) AS m FROM keys),
subs AS (SELECT sent_id, r, p, unnest(range(1, least(m, len(r) - p) + 1)) AS k FROM places, longest),
hits AS (SELECT DISTINCT sent_id, p, p + k AS e FROM subs JOIN keys ON keys.yomi = r[p + 1:p + k]),
steps AS (
  SELECT sent_id, p, p + len(n) AS e FROM num WHERE n <> ''
  UNION ALL SELECT h.sent_id, h.p, h.e FROM hits h JOIN num USING (sent_id, p) WHERE n = ''
  UNION ALL SELECT num.sent_id, num.p, num.p + 1 FROM num ANTI JOIN hits USING (sent_id, p) WHERE n = ''
), reach AS (SELECT sent_id, 0 AS p FROM texts UNION SELECT s.sent_id, s.e FROM reach JOIN steps s ON s.sent_id = reach.sent_id AND s.p = reach.p),
segs AS (SELECT DISTINCT s.sent_id, CAST(s.p AS INT) AS start_pos, CAST(s.e AS INT) AS end_pos, t.r[s.p + 1:s.e] AS yomi FROM steps s JOIN reach USING (sent_id, p) JOIN texts t USING (sent_id))"""

_HIRA, _KATA = "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7)))

_GAINS = """(SELECT word_key, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT DISTINCT * FROM {0}) WHERE word_key IS NOT NULL GROUP BY word_key)"""
_NODES = "(SELECT DISTINCT * FROM word_node WHERE surface IS NOT NULL AND yomi IS NOT NULL)"


def _kansuji_sql() -> str:
    digits = "lpad(CAST(TRY_CAST(surface AS BIGINT) AS VARCHAR), 20, '0')"
    out = []
    for g in range(4, -1, -1):
        four = []
        for p in range(3, -1, -1):
            d = f"substr({digits}, {(4 - g) * 4 + 4 - p}, 1)"
            name = f"translate({d}, '0123456789', '{DIGITS}')"
            four.append(f"CASE WHEN {d} = '0' THEN ''" + (f" WHEN {d} = '1' THEN '{PLACES[p]}'" if p else "") + f" ELSE {name} || '{PLACES[p]}' END")
        out.append(f"CASE WHEN substr({digits}, {(4 - g) * 4 + 1}, 4) = '0000' THEN '' ELSE {' || '.join(four)} || '{GROUPS[g]}' END")
    return f"SELECT DISTINCT surface, CASE WHEN CAST(surface AS BIGINT) = 0 THEN '零' ELSE {' || '.join(out)} END AS kanji FROM intermediate_token WHERE regexp_full_match(surface, '[0-9]+') AND TRY_CAST(surface AS BIGINT) IS NOT NULL"


def _okuri_sql() -> str:
    from kotonami.plans.general_queries import _LINES

    t = default_table()
    rows = [(v, t[v]) for v in VOWELS] + [(c, t[c + v]) for c in "bcdfghjklmnpqrstvwxyz" for v in VOWELS if c + v in t]
    values = ", ".join(f"('{a}', '{b}')" for a, b in rows)
    return _LINES + f", okuri(letter, kana) AS (VALUES {values}) SELECT DISTINCT line_id, left(yomi, len(yomi) - 1) || kana AS yomi, array_to_string(list_transform(found, lambda x: x || kana), '/') AS surfaces FROM judged JOIN okuri ON letter = right(yomi, 1) WHERE reason IS NULL"


_TRIM = r"regexp_replace({0}, '^[\p{{Z}}\x09-\x0d\x{{85}}]+|[\p{{Z}}\x09-\x0d\x{{85}}]+$', '', 'g')"

SQL = {
    "token_merge": f"WITH {_MERGE} SELECT sent_id, run, word FROM merge",
    "kana_preferred": "SELECT DISTINCT sent_id, i, CASE WHEN coalesce(subhinshi = '代名詞', false) OR coalesce(hinshi IN ('形容詞', '副詞', '接続詞', '感動詞', '動詞'), false) THEN yomi ELSE surface END AS surface FROM intermediate_token WHERE surface IS NOT NULL AND yomi IS NOT NULL",
    "start_offsets": "WITH t AS (SELECT DISTINCT sent_id, i, yomi FROM intermediate_token WHERE surface IS NOT NULL AND yomi IS NOT NULL) SELECT sent_id, i, CAST(coalesce(sum(len(yomi)) OVER w, 0) AS BIGINT) AS start_pos, CAST(coalesce(sum(strlen(yomi)) OVER w, 0) AS BIGINT) AS start_byte FROM t WINDOW w AS (PARTITION BY sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "wfreq": f"WITH {_MERGE} SELECT word, cnt FROM freq",
    "unigram_model": f"WITH {_MERGE} SELECT word, word_id, cnt, round({_cost('cnt')}, 6) AS cost FROM vocab, stats",
    "model_totals": f"WITH {_MERGE} SELECT coalesce(t, 0) AS total_words, u AS unique_words, round({_cost('0', 'coalesce(t, 0)')}, 6) AS default_edge_cost FROM stats",
    "bigram_model": f"WITH {_BIGRAMS} SELECT id1, id2, cnt, round({_cost('cnt')}, 6) AS cost FROM big, bstats",
    "bigram_words": f"WITH {_BIGRAMS} SELECT cnt, word1, word2 FROM big WHERE cnt > 16",
    "bigram_rekeyed": f"WITH {_BIGRAMS}, small AS (SELECT word, CAST(row_number() OVER (ORDER BY encode(word)) - 1 AS INT) AS n FROM kept WHERE cnt > 40) SELECT a.n AS id1, b.n AS id2, cnt FROM big JOIN small a ON a.word = word1 JOIN small b ON b.word = word2",
    "new_words": f"WITH {_MERGE}, first AS (SELECT word_key AS word, min((user_id, save_id)) AS place FROM user_unigram WHERE word_key IS NOT NULL GROUP BY word_key), missing AS (SELECT * FROM first ANTI JOIN vocab USING (word)) SELECT word, word_id, cnt FROM vocab UNION ALL SELECT word, CAST(row_number() OVER (ORDER BY place, encode(word)) + (SELECT coalesce(max(word_id), 0) FROM vocab) AS INT), 1 FROM missing",
    "score_rules": f"WITH {_MERGE}, c(a, b) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)}), ({chr(39)}{b}{chr(39)}, {chr(39)}{a}{chr(39)})' for a, b in COPIED)}), copied AS (SELECT word, cnt FROM freq UNION ALL SELECT b, cnt FROM freq JOIN c ON a = word WHERE b NOT IN (SELECT word FROM freq)), r(a, b) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in RAISED)}) SELECT word, greatest(cnt, coalesce((SELECT max(o.cnt + 1) FROM r JOIN copied o ON o.word = r.b WHERE r.a = copied.word), cnt)) AS cnt FROM copied",
    "wiki_text": r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE starts_with(source, 'wiki/') AND text IS NOT NULL), f AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS raw FROM l), t AS (SELECT doc_id, line_no, " + _TRIM.format("raw") + r" AS line FROM f), k AS (SELECT doc_id, line_no, regexp_replace(line, '[（(][ぁ-ゟ、]+[）)]', '', 'g') AS line FROM t WHERE NOT regexp_matches(line, '^(?:<|&lt;|!|$)') AND NOT regexp_matches(line, '^[a-zA-Z0-9|=-]+')) SELECT * FROM k WHERE line <> ''",
    "novel_text": r"WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS path, replace(text, chr(13), '') AS t FROM documents WHERE starts_with(source, 'novel/')), fit AS (SELECT * FROM b WHERE NOT regexp_matches(t, '二倍の踊り字|第3水準|creativecommons\.org|旧字、旧仮名で書かれた作品を、現代表記にあらためる際の作業指針') AND NOT regexp_matches(t, '[ゐヰゑヱ]')), m AS (SELECT path, string_split(regexp_replace(regexp_replace(t, '(?s)^.*-{10,}\r?\n', ''), '(?s)底本：.*', ''), chr(10)) AS ls FROM fit), f AS (SELECT path, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS raw FROM m), t AS (SELECT path, line_no, " + _TRIM.format("raw") + r" AS line FROM f), k AS (SELECT path, line_no, regexp_replace(regexp_replace(line, '《.*?》', '', 'g'), '［＃.*］', '', 'g') AS line FROM t WHERE line <> '' AND NOT regexp_matches(line, '^[a-zA-Z0-9|=-]+')) SELECT * FROM k WHERE line <> ''",
    "dictionary_merged": f"WITH {_DICT} SELECT yomi, array_to_string(surfaces, '/') AS surfaces FROM dict",
    "dictionary_keys": "SELECT DISTINCT yomi FROM dict_decoded WHERE yomi IS NOT NULL",
    "dictionary_okuri": _okuri_sql(),
    "dictionary_of_vocabulary": f"WITH {_MERGE}, s AS (SELECT word, split_part(word, '/', 1) AS surface, substr(word, strpos(word, '/') + 1) AS yomi FROM kept) SELECT yomi, string_agg(surface, '/' ORDER BY encode(word)) AS surfaces FROM s WHERE yomi NOT IN ('UNK', '') AND strpos(yomi, chr(12288)) = 0 AND strpos(surface, chr(12288)) = 0 GROUP BY yomi",
    "dictionary_violations": "WITH r AS (SELECT yomi, unnest(string_split(replace(coalesce(surfaces, ''), '／', '/'), '/')) AS surface FROM dict_entry WHERE yomi IS NOT NULL), p AS (SELECT yomi, surface, CASE WHEN yomi = '' THEN 'empty yomi' WHEN surface = '' THEN 'empty surface' WHEN strpos(yomi, chr(12288)) > 0 THEN 'blank in yomi' WHEN yomi = 'い' AND (len(surface) > 1 OR surface = '好い') THEN 'surface longer than yomi' END AS problem FROM r) SELECT DISTINCT * FROM p WHERE problem IS NOT NULL",
    "dictionary_prefixes": f"WITH {_DICT}, places AS (SELECT item_id, yomi AS r, unnest(range(len(yomi))) AS p FROM eval_item), longest AS (SELECT max(len(yomi)) AS m FROM keys), subs AS (SELECT item_id, p, unnest(range(1, least(m, len(r) - p) + 1)) AS k, r FROM places, longest) SELECT item_id, CAST(p AS INT) AS start_pos, keys.yomi FROM subs JOIN keys ON keys.yomi = r[p + 1:p + k]",
    "dictionary_predictions": "SELECT DISTINCT yomi FROM dict_decoded WHERE starts_with(yomi, 'かい') ORDER BY encode(yomi) LIMIT 10",
    "dictionary_continuations": "WITH p AS (SELECT DISTINCT yomi AS prefix FROM word_node WHERE yomi IS NOT NULL), d AS (SELECT DISTINCT yomi FROM dict_decoded WHERE yomi IS NOT NULL) SELECT prefix, yomi FROM p JOIN d ON starts_with(yomi, prefix)",
    "eval_segments": f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM segs",
    "span_alternatives": f"SELECT sent_id, start_pos, end_pos, string_agg(surface, '|' ORDER BY node_idx) AS surfaces FROM {_NODES} n GROUP BY sent_id, start_pos, end_pos",
    "user_unigram_costs": f"WITH g AS {_GAINS.format('user_unigram')}, s AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM g) SELECT word_key, cnt, round({_cost('cnt')}, 6) AS cost FROM g, s",
    "user_bigram_costs": f"WITH g AS {_GAINS.format('user_bigram')}, s AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM g) SELECT word_key, cnt, round({_cost('cnt')}, 6) AS cost FROM g, s",
    "streaming_user_counts": f"SELECT * FROM {_GAINS.format('user_unigram')} g",
    "bigram_dump": f"WITH {_BIGRAMS} SELECT round({_cost('cnt')}, 6) AS cost, word1, word2 FROM big, bstats",
    "kansuji_numbers": _kansuji_sql(),
}
