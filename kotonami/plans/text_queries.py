"""Queries of scalar functions, clauses and input over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions import romaji, text
from kotonami.operators import clauses, counts, training
from kotonami.plans import reference_queries as base
from kotonami.runtime import table
from kotonami.streaming import ime


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct surface and reading of the corpus and the lattices."""
    parts = [table(spark, sf_dir, t).select(F.explode(F.array("surface", "yomi")).alias("value")) for t in ("intermediate_token", "word_node")]
    return parts[0].union(parts[1]).where("value is not null").distinct()


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct run of Latin letters in the documents, as typed input."""
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z'-]+"), F.lit(0))).alias("typed")).distinct()


def lines_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that some cleaning step changes, after each of the steps: readings, ruby, notes, blanks at the ends; and whether the kana are old."""
    steps = {"no_readings": text.strip_readings, "no_ruby": text.strip_ruby, "no_notes": text.strip_notes, "trimmed": text.trim_unicode}
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", "line", *[f(F.col("line")).alias(n) for n, f in steps.items()], text.is_kyukana(F.col("line")).alias("old_kana"))
    return rows.where(F.col("old_kana") | F.exists(F.array(*steps), lambda x: x != F.col("line"))).drop("line")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the documents without what stands before a line of hyphens and behind a colophon."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(text.strip_meta(F.col("text"))).alias("n"))


def width_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surface and reading in the other kana, and in each width."""
    forms = {"katakana": text.hira2kata, "hiragana": text.kata2hira, "half_kana": text.half_kana, "full_kana": text.full_kana, "full_ascii": text.full_ascii, "half_ascii": text.half_ascii}
    return _surfaces(spark, sf_dir).select("value", *[f(F.col("value")).alias(n) for n, f in forms.items()])


def leading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each surface or reading begins with."""
    return _surfaces(spark, sf_dir).select("value", text.segment_number(F.col("value")).alias("number")).where("number <> ''")


def analysed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes written as an analyser's feature field, and read again."""
    t = table(spark, sf_dir, "intermediate_token").where("surface is not null")
    field = F.concat_ws(",", "hinshi", "subhinshi", "subsubhinshi", F.lit("*,*,*"), "surface", text.hira2kata(F.col("yomi")))
    return t.select("sent_id", "i", text.mecab_features(field, F.col("surface")).alias("f")).select("sent_id", "i", "f.*").distinct()


def typed_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed input in hiragana, and in the other direct conversions."""
    kinds = ("hiragana", "katakana", "half_katakana", "full_romaji", "half_romaji")
    return _inputs(spark, sf_dir).select("typed", *[ime.direct_conversion(F.col("typed"), F.lit(k)).alias(k) for k in kinds])


def typed_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed input without its last kana."""
    return _inputs(spark, sf_dir).select("typed", romaji.remove_last_char(F.col("typed")).alias("erased"))


def typed_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consonants at the end of every typed input that wait for a vowel, its state, and whether it is left as it is."""
    parts = text.consonant_suffix(F.col("typed"))
    return _inputs(spark, sf_dir).select("typed", parts["preedit"].alias("settled"), parts["suffix"].alias("waiting"), ime.input_state(F.col("typed"), F.lit(0)).alias("state"), ime.bypasses(F.col("typed")).alias("bypassed"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the words of each merged sentence, up to the words of a run each."""
    rows = base.token_merge(spark, sf_dir).select("sent_id", "run", F.split("word", "/", 2)[1].alias("y")).where("y <> ''")
    lists = rows.groupBy("sent_id", F.floor(F.col("run") / 16).alias("part")).agg(F.sort_array(F.collect_list(F.struct("run", "y"))).alias("l"))
    return lists.select("sent_id", "part", F.transform("l", lambda x: x["y"]).alias("cs"))


def clause_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each clause of a sentence's parts of 16 morphemes begins and ends."""
    return _clauses(spark, sf_dir).select("sent_id", "part", F.posexplode(clauses.ranges(F.col("cs"))).alias("clause_i", "r")).select("sent_id", "part", "clause_i", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))


def clauses_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause with its right border moved to the right, and to the left; and the focus moved on."""
    each = _clauses(spark, sf_dir).select("sent_id", "part", "cs", F.explode(F.sequence(F.lit(0), F.size("cs") - 1)).alias("focus"))
    show = lambda c: F.array_join(c, "|")
    cs, at = F.col("cs"), F.col("focus")
    return each.select("sent_id", "part", "focus", show(clauses.extend_right(cs, at)).alias("right"), show(clauses.extend_left(cs, at)).alias("left"), clauses.moved_focus(at, F.size(cs), 1).alias("next_focus"), clauses.moved_focus(at, F.size(cs), -1).alias("previous_focus"))


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sentences as lines of words in parts of 16 morphemes."""
    rows = base.token_merge(spark, sf_dir)
    lists = rows.groupBy("sent_id", F.floor(F.col("run") / 16).alias("part")).agg(F.sort_array(F.collect_list(F.struct("run", "word"))).alias("l"))
    return lists.select("sent_id", "part", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("line"))


def words_of_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the words of tokenized lines."""
    return counts.word_frequencies(counts.words_of_lines(_corpus_lines(spark, sf_dir), "line"))


def annotated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of annotated lines with the offsets of their readings."""
    lines = _corpus_lines(spark, sf_dir).select((F.col("sent_id") * 100_000 + F.col("part")).alias("sent_id"), "line")
    return training.parse_annotated(lines).select("sent_id", "i", "surface", "yomi", F.col("start_pos").cast("bigint").alias("start_pos"))


QUERIES = {f.__name__: f for f in (lines_changed, bodies, width_forms, leading_numbers, analysed_features, typed_kana, typed_erased, typed_waiting, clause_offsets, clauses_moved, words_of_corpus_lines, annotated_words)}

# -- SQL -----------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(col: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        col = f"replace({col}, {_q(a)}, {_q(b)})"
    return col


def _half(col: str) -> str:
    pairs = [(v, p + "゛") for p, v in zip(*text.VOICED)] + [(v, p + "゜") for p, v in zip(*text.HALF_VOICED)]
    return f"translate({_replaced(col, pairs)}, '{text.FULL_KANA}', '{text.HALF_KANA}')"


def _full(col: str) -> str:
    pairs = [(p + "゛", v) for p, v in zip(*text.VOICED)] + [(p + "゜", v) for p, v in zip(*text.HALF_VOICED)]
    return _replaced(f"translate({col}, '{text.HALF_KANA}', '{text.FULL_KANA}')", pairs)


_BLANK = chr(0x3000)
_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM l)"
_VALUES = "v AS (SELECT DISTINCT value FROM (SELECT surface AS value FROM intermediate_token UNION ALL SELECT yomi FROM intermediate_token UNION ALL SELECT surface FROM word_node UNION ALL SELECT yomi FROM word_node) WHERE value IS NOT NULL)"
_TYPED = "t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z''-]+')) AS typed FROM documents)"
_TABLE = romaji.default_table()
_LONGEST = max(map(len, _TABLE))
_KEYS = f"keys(k, v) AS (VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in _TABLE.items())})"
_STEP = f"coalesce({', '.join(f'k{n}.v' for n in range(_LONGEST, 0, -1))}, substr(s, p, 1))"
_WIDE = f"CASE {' '.join(f'WHEN k{n}.v IS NOT NULL THEN {n}' for n in range(_LONGEST, 0, -1))} ELSE 1 END"
_ROMAJI = f"""
walk AS (
  SELECT typed, replace(lower(typed), 'nn', 'n''') AS s, 1 AS p, '' AS kana FROM t
  UNION ALL
  SELECT typed, s, p + {_WIDE}, kana || {_STEP} FROM walk {' '.join(f'LEFT JOIN keys k{n} ON k{n}.k = substr(s, p, {n}) AND len(s) >= p + {n} - 1' for n in range(1, _LONGEST + 1))} WHERE p <= len(s)),
kana AS (SELECT typed, kana FROM walk WHERE p > len(s))"""
_PARTS = """
cl AS (SELECT sent_id, run // 16 AS part, list(y ORDER BY run) AS cs FROM (SELECT sent_id, run, substr(word, strpos(word, '/') + 1) AS y FROM merge) WHERE y <> '' GROUP BY ALL)"""
_CORPUS = "cl AS (SELECT sent_id, run // 16 AS part, string_agg(word, ' ' ORDER BY run) AS line FROM merge GROUP BY ALL)"

SQL = {
    "lines_changed": f"WITH {_LINES}, c AS (SELECT doc_id, line_no, line, regexp_replace(line, '[（(][ぁ-ゟ、]+[）)]', '', 'g') AS no_readings, regexp_replace(line, '《.*?》', '', 'g') AS no_ruby, regexp_replace(line, '［＃.*］', '', 'g') AS no_notes, {base._TRIM.format('line')} AS trimmed, regexp_matches(line, '[ゐヰゑヱ]') AS old_kana FROM f) SELECT * EXCLUDE (line) FROM c WHERE old_kana OR no_readings <> line OR no_ruby <> line OR no_notes <> line OR trimmed <> line",
    "bodies": r"SELECT doc_id, CAST(len(regexp_replace(regexp_replace(text, '(?s)^.*-{10,}\r?\n', ''), '(?s)底本：.*', '')) AS INT) AS n FROM documents WHERE text IS NOT NULL",
    "width_forms": f"WITH {_VALUES} SELECT value, translate(value, '{text.HIRAGANA}', '{text.KATAKANA}') AS katakana, translate(value, '{text.KATAKANA}', '{text.HIRAGANA}') AS hiragana, {_half('value')} AS half_kana, {_full('value')} AS full_kana, translate(value, {_q(' ' + text.HALF_ASCII)}, '{_BLANK + text.FULL_ASCII}') AS full_ascii, translate(value, '{_BLANK + text.FULL_ASCII}', {_q(' ' + text.HALF_ASCII)}) AS half_ascii FROM v",
    "leading_numbers": rf"WITH {_VALUES} SELECT value, regexp_extract(value, '^((?:0|[1-9][0-9]*)(?:\.[0-9]*)?)', 1) AS number FROM v WHERE regexp_matches(value, '^[0-9]')",
    "analysed_features": f"WITH c AS (SELECT sent_id, i, surface, string_split(concat_ws(',', hinshi, subhinshi, subsubhinshi, '*,*,*', surface, translate(yomi, '{text.HIRAGANA}', '{text.KATAKANA}')), ',') AS c FROM intermediate_token WHERE surface IS NOT NULL) SELECT DISTINCT sent_id, i, c[1] AS hinshi, CASE WHEN len(c) > 2 THEN c[2] ELSE 'UNK' END AS subhinshi, CASE WHEN len(c) > 3 THEN c[3] ELSE 'UNK' END AS subsubhinshi, translate(CASE WHEN len(c) > 7 THEN c[8] ELSE surface END, '{text.KATAKANA}', '{text.HIRAGANA}') AS yomi FROM c",
    "typed_kana": f"WITH RECURSIVE {_TYPED}, {_KEYS}, {_ROMAJI} SELECT typed, kana AS hiragana, translate(kana, '{text.HIRAGANA}', '{text.KATAKANA}') AS katakana, {_half(f'translate(kana, {_q(text.HIRAGANA)}, {_q(text.KATAKANA)})')} AS half_katakana, translate(typed, {_q(' ' + text.HALF_ASCII)}, '{_BLANK + text.FULL_ASCII}') AS full_romaji, typed AS half_romaji FROM kana",
    "typed_erased": f"WITH {_TYPED}, {_KEYS} SELECT typed, left(typed, len(typed) - {_WIDE}) AS erased FROM t {' '.join(f'LEFT JOIN keys k{n} ON k{n}.k = right(typed, {n}) AND len(typed) >= {n}' for n in range(1, _LONGEST + 1))}",
    "typed_waiting": rf"WITH {_TYPED}, h AS (SELECT typed, NOT regexp_matches(typed, '{text.SETTLED}$') AND regexp_matches(typed, '^(.*?(?:nn)*)([{text.WAITING}]+)$') AS hit FROM t) SELECT typed, CASE WHEN hit THEN regexp_extract(typed, '^(.*?(?:nn)*)([{text.WAITING}]+)$', 1) ELSE typed END AS settled, CASE WHEN hit THEN regexp_extract(typed, '^(.*?(?:nn)*)([{text.WAITING}]+)$', 2) ELSE '' END AS waiting, 'Composition' AS state, regexp_matches(typed, '^[A-Z]') AS bypassed FROM h",
    "clause_offsets": f"WITH {base._MERGE}, {_PARTS}, x AS (SELECT sent_id, part, unnest(range(len(cs))) AS k, cs FROM cl) SELECT sent_id, part, CAST(k AS INT) AS clause_i, CAST(len(array_to_string(cs[:k], '')) AS INT) AS start_pos, CAST(len(array_to_string(cs[:k + 1], '')) AS INT) AS end_pos FROM x",
    "clauses_moved": f"""WITH {base._MERGE}, {_PARTS}, x AS (SELECT sent_id, part, cs, len(cs) AS n, CAST(unnest(range(len(cs))) AS INT) AS f FROM cl), y AS (SELECT *, cs[f + 1] AS cur, cs[f + 2] AS nxt, CASE WHEN f > 0 THEN cs[f] END AS prv FROM x),
z AS (SELECT sent_id, part, f, n,
  CASE WHEN f + 1 < n THEN list_concat(cs[:f], [cur || nxt[1], nxt[2:]], cs[f + 3:]) ELSE cs END AS r,
  CASE WHEN n = 1 THEN CASE WHEN len(cur) > 1 THEN [cur[:-2], cur[-1]] ELSE cs END
       WHEN f = 0 THEN CASE WHEN len(cur) > 1 THEN list_concat([cur[:-2], cur[-1] || nxt], cs[3:]) ELSE cs END
       ELSE list_concat(cs[:f - 1], [prv[:-2], prv[-1] || cur], cs[f + 2:]) END AS l FROM y)
SELECT sent_id, part, f AS focus, array_to_string(list_filter(r, lambda x: x <> ''), '|') AS right, array_to_string(list_filter(l, lambda x: x <> ''), '|') AS left, CAST((f + 1) % n AS INT) AS next_focus, CAST((f + n - 1) % n AS INT) AS previous_focus FROM z""",
    "words_of_corpus_lines": f"WITH {base._MERGE}, {_CORPUS}, w AS (SELECT unnest(string_split(trim(line, ' '), ' ')) AS word FROM cl) SELECT word, count(*) AS cnt FROM w WHERE word <> '' AND strpos(word, chr(8207)) = 0 AND NOT starts_with(word, '/') GROUP BY word HAVING NOT regexp_matches(word, '^[\\x{{30A0}}-\\x{{30FF}}]{{2}}/[\\x{{3040}}-\\x{{309F}}]{{2}}$')",
    "annotated_words": f"""WITH {base._MERGE}, {_CORPUS}, w AS (SELECT sent_id * 100000 + part AS id, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM cl WHERE trim(line, ' ') <> '' AND NOT starts_with(line, ';;') AND NOT regexp_matches(line, '(?:^| )/')),
x AS (SELECT id, CAST(unnest(range(len(ws))) AS INT) AS i, unnest(ws) AS word FROM w), y AS (SELECT id, i, split_part(word, '/', 1) AS surface, CASE WHEN contains(word, '/') THEN substr(word, strpos(word, '/') + 1) ELSE word END AS yomi FROM x)
SELECT id AS sent_id, i, surface, yomi, CAST(coalesce(sum(len(yomi)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM y""",
}
