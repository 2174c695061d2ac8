"""Queries of dictionary building, lattices, decoding, evaluation and training over the given tables, and their SQL.

The decoder's SQL is a dynamic program as a recursive query: one row a lattice and step, which
carries the forward costs of the nodes so far as a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions.text import lcs_length, word_key
from kotonami.operators import counts, decode, dictionary, evaluate, lattice, training
from kotonami.operators.badrows import read_records
from kotonami.operators.costs import totals, with_costs
from kotonami.operators.tokenize import longest_match
from kotonami.plans import reference_queries as base
from kotonami.plans.engine import COST_DIGITS, Engine
from kotonami.plans.general_queries import _LINES
from kotonami.runtime import cut_lineage, table
from kotonami.streaming import userdata

# -- dictionaries --------------------------------------------------------------------------


def _of_usage(spark: SparkSession, sf_dir: str, usage: str) -> DataFrame:
    rows = dictionary.of_usage(base._entries(spark, sf_dir), table(spark, sf_dir, "dict_config"), usage)
    return dictionary.merged(dictionary.to_rows(rows.withColumnRenamed("dict_id", "src_rank"), "src_rank"))


def dictionaries_by_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured dictionaries of each usage, merged in order."""
    named = [_of_usage(spark, sf_dir, u).select(F.lit(u).alias("usage"), "yomi", F.array_join("surfaces", "/").alias("surfaces")) for u in ("Normal", "SingleTerm", "Disabled")]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intermediate_token").where("surface is not null and yomi is not null").where(F.col("surface").rlike(r"[^\p{Z}\x09-\x0d]"))


def _katakana_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable records as word-list rows (line_no, c): the word, its class, and its reading in katakana in the 11th column."""
    rows = read_records(table(spark, sf_dir, "dict_line"), "line", ["line_id"]).where("reason is null").select("line_id", "yomi", "hinshi", F.posexplode("candidates").alias("pos", "surface"))
    kata = F.translate("yomi", base._HIRA, base._KATA)
    return rows.select((F.col("line_id") * 1000 + F.col("pos")).alias("line_no"), F.array(F.col("surface"), *[F.lit("*")] * 3, F.col("hinshi"), *[F.lit("*")] * 5, kata).alias("c"))


def _system(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    normal = dictionary.in_known_characters(_of_usage(spark, sf_dir, "Normal"), tokens, "surface")
    return dictionary.system_dictionary(normal, vocab, tokens.select("sent_id", "i", "yomi", "surface"), dictionary.from_unidic(_katakana_words(spark, sf_dir)))


def system_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal dictionaries without garbled candidates, the vocabulary, the corpus and katakana words, merged."""
    return _system(spark, sf_dir, counts.vocabulary(base.wfreq(spark, sf_dir))).select("yomi", F.array_join("surfaces", "/").alias("surfaces"))


def missing_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the corpus that no normal dictionary has."""
    readings = _tokens(spark, sf_dir).where("yomi <> ''").select("yomi").distinct()
    return readings.join(_of_usage(spark, sf_dir, "Normal").select("yomi"), "yomi", "left_anti")


def system_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the normal and single-term dictionaries, each once."""
    return _of_usage(spark, sf_dir, "Normal").select("yomi").union(_of_usage(spark, sf_dir, "SingleTerm").select("yomi")).distinct()


# -- engine --------------------------------------------------------------------------------


def _user_counts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return userdata.summed_gains(table(spark, sf_dir, name)).withColumnRenamed("word_key", "key")


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    merged = base._merged(spark, sf_dir)
    vocab = cut_lineage(base._vocab(spark, sf_dir, merged=merged))
    return vocab, cut_lineage(base._bigrams(merged, vocab))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The system dictionary, models of the corpus, and the statistics of all users."""
    vocab, pairs = _models(spark, sf_dir)
    users = [cut_lineage(_user_counts(spark, sf_dir, n)) for n in ("user_unigram", "user_bigram")]
    return Engine(vocab, pairs, cut_lineage(_system(spark, sf_dir, vocab)), user_unigram=users[0], user_bigram=users[1])


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, yomi, surface) of the sentences of the test passages, whose readings and surfaces have the same full stops."""
    cut = lambda c: F.filter(F.split(F.regexp_replace(c, "。", "。\n"), "\n", -1), lambda x: x != "")
    rows = table(spark, sf_dir, "eval_item").select("item_id", F.posexplode(F.arrays_zip(cut("yomi").alias("y"), cut("surface").alias("s"))).alias("k", "z"))
    return rows.select((F.col("item_id") * 1000 + F.col("k")).cast("bigint").alias("sent_id"), F.col("z.y").alias("yomi"), F.col("z.s").alias("surface"))


def eval_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice nodes of the test sentences, numbered, with their costs under the models and the users' statistics."""
    node, _, _ = _engine(spark, sf_dir).lattice(_sentences(spark, sf_dir).select("sent_id", "yomi"))
    return node.select("sent_id", "node_idx", "start_pos", "end_pos", "surface", "yomi", "auto_generated", "node_cost")


def eval_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best conversions of the test sentences."""
    return decode.best_text(_engine(spark, sf_dir).convert(_sentences(spark, sf_dir).select("sent_id", "yomi")))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and recall of the conversions of the test sentences."""
    return _engine(spark, sf_dir).evaluate(_sentences(spark, sf_dir)).select("good", "bad", F.round("recall", 6).alias("recall"))


# -- lattices of the given nodes -----------------------------------------------------------


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float]:
    """The given lattices under the corpus models and the users' statistics: nodes, known edges, default edge cost."""
    vocab, pairs = _models(spark, sf_dir)
    node = lattice.with_unigram(base._nodes(spark, sf_dir).drop("word_id", "score"), with_costs(vocab, totals(vocab)))
    own = userdata.user_costs(_user_counts(spark, sf_dir, "user_unigram")).select("key", F.col("cost").alias("user_cost"))
    node = node.join(own, word_key(F.col("surface"), F.col("yomi")) == F.col("key"), "left").drop("key")
    stats = totals(vocab).first()
    cost = lattice.node_cost(F.col("surface"), F.col("yomi"), F.col("score"), F.col("user_cost"), F.lit(stats["total_words"]), F.lit(stats["unique_words"]))
    node = cut_lineage(node.withColumn("node_cost", F.round(cost, COST_DIGITS)))
    edge = lattice.known_edges(node, with_costs(pairs, totals(pairs)), userdata.user_costs(_user_counts(spark, sf_dir, "user_bigram")))
    return node, edge.withColumn("edge_cost", F.round("edge_cost", COST_DIGITS)), round(totals(pairs).first()["default_edge_cost"], COST_DIGITS)


def node_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of lattice nodes: the users', the model's or those of unknown words; word_id where the model knows the word."""
    return _given(spark, sf_dir)[0].select("sent_id", "node_idx", "word_id", "node_cost")


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of edges between lattice nodes that meet: the users', the model's, else the default."""
    node, known, default = _given(spark, sf_dir)
    met = lattice.adjacent(node, []).join(known, ["sent_id", "prev_idx", "node_idx"], "left")
    return met.select("sent_id", "prev_idx", "node_idx", F.coalesce("edge_cost", F.lit(default)).alias("edge_cost"))


def lattice_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates of every clause of every lattice, compounds included."""
    return decode.decode(*_given(spark, sf_dir)).withColumn("cost", F.round("cost", COST_DIGITS))


def lattice_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the cheapest path of every lattice."""
    return decode.best_text(decode.decode(*_given(spark, sf_dir)))


def lattice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by page of ten."""
    return decode.page(decode.decode(*_given(spark, sf_dir))).select("sent_id", "clause_i", "rank", "page")


def lattice_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattices as graph descriptions, with the costs of their edges."""
    node, known, default = _given(spark, sf_dir)
    met = lattice.adjacent(node, []).join(known, ["sent_id", "prev_idx", "node_idx"], "left").withColumn("edge_cost", F.coalesce("edge_cost", F.lit(default)))
    return lattice.dot_graph(node, met)


# -- training ------------------------------------------------------------------------------


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, i, surface, yomi) of the test sentences, cut at their longest words of the corpus: a small annotated corpus."""
    words = dictionary.to_rows(_of_usage(spark, sf_dir, "Normal")).select("surface", "yomi")
    return longest_match(table(spark, sf_dir, "eval_item").select(F.col("item_id").cast("bigint").alias("sent_id"), F.col("surface").alias("text")), words)


def teacher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pair of neighbours stands in the annotated corpus, by word."""
    return training.pair_gains(_annotated(spark, sf_dir), 1).select("w1", "w2", F.col("more").alias("cnt"))


def learning_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with the words of the annotated corpus that it lacks."""
    used = _annotated(spark, sf_dir).select("sent_id", F.col("i").alias("pos"), word_key(F.col("surface"), F.col("yomi")).alias("word"))
    return counts.missing_words(used, base._vocab(spark, sf_dir))


def learned_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of known words after one correcting step on every annotated sentence; words that the model lacks stay out."""
    rows = _annotated(spark, sf_dir)
    return training.stepped_unigrams(base._vocab(spark, sf_dir), training.word_gains(rows, 1))


def learned_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts after one correcting step on every annotated sentence: known pairs change, new ones come in."""
    vocab, pairs = _models(spark, sf_dir)
    return training.stepped_bigrams(pairs, vocab, training.pair_gains(_annotated(spark, sf_dir), 1))


# -- scalar functions and dumps over the models --------------------------------------------


def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of each vocabulary word's surface and reading."""
    w = counts.vocabulary(base.wfreq(spark, sf_dir)).select("word", F.split("word", "/", 2)[0].alias("a"), F.split("word", "/", 2)[1].alias("b"))
    return w.select("word", lcs_length(F.col("a"), F.col("b")).cast("bigint").alias("common"))


def unigram_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram model as lines 'word id cost', and two lines of its totals."""
    vocab = cut_lineage(base._vocab(spark, sf_dir))
    line = lambda *c: F.concat_ws(" ", *c).alias("line")
    rows = with_costs(vocab, totals(vocab)).select(line("word", F.col("word_id").cast("string"), F.round("cost", 4).cast("decimal(10,4)").cast("string")))
    sums = totals(vocab)
    ends = [sums.select(line(F.lit(f"__{n.upper()}__"), F.col(n).cast("string"))) for n in ("total_words", "unique_words")]
    return rows.unionByName(ends[0]).unionByName(ends[1])


def passages_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test passages as longest known words, by the words of the normal dictionaries."""
    return _annotated(spark, sf_dir)


def distinct_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words that the annotated corpus holds, and the readings and surfaces of its passages put together again."""
    nodes = _annotated(spark, sf_dir)
    words = training.correct_nodes(nodes).groupBy("sent_id").agg(F.count("*").alias("words"))
    return training.sentences(nodes).join(words, "sent_id")


def document_lines_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the corpus documents as evaluation lines: reading and surface, or the reason why a line is none."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return evaluate.judged_lines(lines, ["doc_id", "line_no"])


QUERIES = {f.__name__: f for f in (
    dictionaries_by_usage, system_dictionary, missing_readings, system_keys, eval_nodes, eval_converted, eval_scores, node_costs, lattice_edges, lattice_decoded, lattice_best, lattice_pages, lattice_graphs,
    teacher_pairs, learning_vocabulary, learned_unigrams, learned_bigrams, word_overlap, unigram_dump, passages_tokenized, distinct_annotated, document_lines_judged,
)}

# -- SQL -----------------------------------------------------------------------------------

_cost = base._cost

_USAGE = base._DICT + """,
used AS (SELECT dict_id, CASE lower(trim(coalesce(usage, 'Disabled'))) WHEN 'normal' THEN 'Normal' WHEN 'singleterm' THEN 'SingleTerm' ELSE 'Disabled' END AS usage FROM dict_config),
ufirst AS (SELECT usage, yomi, surface, min((dict_id, pos)) AS place FROM flat JOIN used USING (dict_id) GROUP BY ALL),
udict AS (SELECT usage, yomi, list(surface ORDER BY place, surface) AS surfaces FROM ufirst GROUP BY ALL)"""

_TOKENS = r"""tk AS (SELECT sent_id, i, surface, yomi FROM intermediate_token WHERE surface IS NOT NULL AND yomi IS NOT NULL AND regexp_matches(surface, '[^\p{Z}\x09-\x0d]'))"""

_SYSTEM = (
    _USAGE
    + ", "
    + _TOKENS
    + f""",
chars AS (SELECT DISTINCT unnest(string_split(surface, '')) AS ch FROM tk),
strange AS (SELECT DISTINCT surface FROM (SELECT surface, unnest(string_split(surface, '')) AS ch FROM ufirst) ANTI JOIN chars USING (ch)),
lines AS (SELECT yomi, surface, line_id * 1000 + pos AS line_no FROM (SELECT line_id, yomi, unnest(found) AS surface, unnest(range(len(found))) AS pos FROM judged WHERE reason IS NULL)
  WHERE regexp_matches(surface, '^[\\x{{30A0}}-\\x{{30FF}}]') AND surface = translate(yomi, '{base._HIRA}', '{base._KATA}')),
sources AS (
  SELECT 0 AS src, row_number() OVER (PARTITION BY yomi ORDER BY place, surface) AS pos, yomi, surface FROM ufirst ANTI JOIN strange USING (surface) WHERE usage = 'Normal' AND surface <> chr(12288)
  UNION ALL SELECT 1, row_number() OVER (PARTITION BY yomi ORDER BY encode(word)), yomi, surface FROM (SELECT word, split_part(word, '/', 1) AS surface, substr(word, strpos(word, '/') + 1) AS yomi FROM kept) WHERE yomi NOT IN ('UNK', '') AND strpos(yomi, chr(12288)) = 0 AND strpos(surface, chr(12288)) = 0
  UNION ALL SELECT 2, row_number() OVER (PARTITION BY yomi ORDER BY place, encode(surface)), yomi, surface FROM (SELECT yomi, surface, min((sent_id, i)) AS place FROM tk WHERE yomi <> '' GROUP BY ALL)
  UNION ALL SELECT 3, 1, translate(surface, '{base._KATA}', '{base._HIRA}'), surface FROM (SELECT DISTINCT surface FROM lines)),
sysfirst AS (SELECT yomi, surface, min((src, pos)) AS place FROM sources GROUP BY ALL),
sysdict AS (SELECT yomi, list(surface ORDER BY place, surface) AS surfaces FROM sysfirst GROUP BY yomi)"""
)
_LINES_CTE = _LINES.strip().removeprefix("WITH ")

#: Costs of words and pairs by key: the users', then the model's.
_LM = (
    base._BIGRAMS
    + f""",
gu AS {base._GAINS.format("user_unigram")}, gus AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM gu),
gb AS {base._GAINS.format("user_bigram")}, gbs AS (SELECT CAST(sum(cnt) AS BIGINT) AS t, count(*) AS u FROM gb),
ucost AS (SELECT word_key AS key, {_cost("cnt")} AS cost FROM gu, gus), bcost AS (SELECT word_key AS key, {_cost("cnt")} AS cost FROM gb, gbs),
mcost AS (SELECT word, word_id, {_cost("cnt")} AS cost FROM vocab, stats), pcost AS (SELECT id1, id2, {_cost("cnt")} AS cost FROM big, bstats),
nocost AS (SELECT {_cost("0", "coalesce(t, 0)")} AS c0, {_cost("1", "coalesce(t, 0)")} AS c1 FROM stats), dflt AS (SELECT round({_cost("0", "coalesce(t, 0)")}, 6) AS d FROM bstats)"""
)


def _costed(source: str) -> str:
    """CTEs n (costed nodes) and e (costed edges) of nodes in `source`."""
    return f""",
n AS (SELECT r.sent_id, r.node_idx, r.start_pos, r.end_pos, r.surface, r.yomi, r.auto_generated, CASE WHEN NOT r.auto_generated THEN m.word_id END AS word_id,
  round(coalesce(uc.cost, CASE WHEN NOT r.auto_generated THEN m.cost END, CASE WHEN strlen(r.surface) < strlen(r.yomi) THEN c1 ELSE c0 END), 6) AS node_cost
  FROM {source} r LEFT JOIN mcost m ON m.word = r.surface || '/' || r.yomi LEFT JOIN ucost uc ON uc.key = r.surface || '/' || r.yomi, nocost),
e AS (SELECT a.sent_id, a.node_idx AS prev_idx, b.node_idx, coalesce(round(coalesce(bc.cost, p.cost), 6), d) AS edge_cost
  FROM n a JOIN n b ON a.sent_id = b.sent_id AND a.end_pos = b.start_pos AND a.node_idx <> b.node_idx
  LEFT JOIN bcost bc ON bc.key = a.surface || '/' || a.yomi || chr(9) || b.surface || '/' || b.yomi LEFT JOIN pcost p ON p.id1 = a.word_id AND p.id2 = b.word_id, dflt)"""


_DECODE = f""",
ends AS (SELECT sent_id, min(end_pos) AS b, max(end_pos) AS m, arg_min(node_idx, (end_pos, node_idx)) AS bos, arg_min(node_idx, (-end_pos, node_idx)) AS eos FROM n GROUP BY sent_id),
walk AS (
  SELECT sent_id, b AS p, m, [{{'i': bos, 'e': b, 'c': 0.0::DOUBLE, 'b': NULL::INT}}] AS st FROM ends
  UNION ALL
  SELECT w.sent_id, w.p + 1, w.m, list_concat(w.st, coalesce(s.l, [])) FROM walk w LEFT JOIN (
    SELECT sent_id, list({{'i': i, 'e': e, 'c': best.c + node_cost, 'b': best.k}}) AS l FROM (
      SELECT x.sent_id, n.node_idx AS i, n.end_pos AS e, n.node_cost, min({{'c': x.s.c + e.edge_cost, 'k': x.s.i}}) AS best
      FROM (SELECT sent_id, p, unnest(st) AS s FROM walk) x JOIN n ON n.sent_id = x.sent_id AND n.start_pos = x.s.e AND n.end_pos = x.p + 1 JOIN e ON e.sent_id = n.sent_id AND e.prev_idx = x.s.i AND e.node_idx = n.node_idx
      GROUP BY ALL) GROUP BY sent_id) s ON s.sent_id = w.sent_id WHERE w.p < w.m),
fw AS (SELECT sent_id, s.i AS i, s.c AS c, s.b AS b FROM (SELECT sent_id, unnest(st) AS s FROM walk WHERE p = m)),
path AS (
  SELECT fw.sent_id, fw.b AS i FROM fw JOIN ends ON ends.sent_id = fw.sent_id AND ends.eos = fw.i
  UNION ALL SELECT path.sent_id, fw.b FROM path JOIN fw ON fw.sent_id = path.sent_id AND fw.i = path.i WHERE fw.b IS NOT NULL),
clause AS (SELECT path.sent_id, path.i, n.start_pos, n.end_pos, n.yomi, CAST(row_number() OVER (PARTITION BY path.sent_id ORDER BY n.end_pos) - 1 AS INT) AS clause_i FROM path JOIN ends USING (sent_id) JOIN n ON n.sent_id = path.sent_id AND n.node_idx = path.i WHERE path.i <> ends.bos),
strict AS (SELECT k.sent_id, k.clause_i, CAST(row_number() OVER (PARTITION BY k.sent_id, k.clause_i ORDER BY fw.c, n.node_idx) AS INT) AS rank, n.surface, n.yomi, fw.c AS cost, false AS compound_word, n.node_idx = k.i AS on_path
  FROM clause k JOIN n ON n.sent_id = k.sent_id AND n.start_pos = k.start_pos AND n.end_pos = k.end_pos JOIN fw ON fw.sent_id = n.sent_id AND fw.i = n.node_idx)"""

_COMPOUNDS = f""",
few AS (SELECT k.*, c.n AS had FROM clause k JOIN (SELECT sent_id, clause_i, count(*) AS n FROM strict GROUP BY ALL) c USING (sent_id, clause_i) WHERE c.n < {decode.FEW}),
nf AS (SELECT n.*, fw.c AS fc FROM n JOIN fw ON fw.sent_id = n.sent_id AND fw.i = n.node_idx JOIN ends ON ends.sent_id = n.sent_id WHERE n.node_idx NOT IN (ends.bos, ends.eos)),
todo AS (
  SELECT sent_id, clause_i, start_pos, end_pos AS upto, yomi, '' AS surface, '' AS reading, 0.0::DOUBLE AS tail, NULL::INT AS after, 0 AS depth, []::INT[] AS ord FROM few
  UNION ALL
  SELECT sent_id, clause_i, start_pos, upto, yomi, surface, reading, tail, after, depth, list_append(ord, CAST(k AS INT)) FROM (
    SELECT t.sent_id, t.clause_i, t.start_pos, t.upto - (nf.end_pos - nf.start_pos) AS upto, t.yomi, nf.surface || t.surface AS surface, nf.yomi || t.reading AS reading,
      t.tail + (t.tail + nf.node_cost + CASE WHEN t.after IS NULL THEN d ELSE coalesce(e.edge_cost, d) END) AS tail, nf.node_idx AS after, t.depth + 1 AS depth, t.ord,
      row_number() OVER (PARTITION BY t.sent_id, t.clause_i, t.ord ORDER BY nf.fc + (t.tail + nf.node_cost + CASE WHEN t.after IS NULL THEN d ELSE coalesce(e.edge_cost, d) END), nf.node_idx) AS k
    FROM todo t JOIN nf ON nf.sent_id = t.sent_id AND nf.end_pos = t.upto AND nf.start_pos >= t.start_pos AND nf.yomi <> t.yomi
    LEFT JOIN e ON e.sent_id = t.sent_id AND e.prev_idx = nf.node_idx AND e.node_idx = t.after, dflt WHERE len(t.reading) <> len(t.yomi)) WHERE k <= {decode.BRANCHES} AND depth <= {decode.DEPTH}),
made AS (SELECT todo.*, few.had FROM todo JOIN few USING (sent_id, clause_i) WHERE len(reading) = len(few.yomi)),
decoded AS (
  SELECT * FROM strict UNION ALL
  SELECT sent_id, clause_i, CAST(had + row_number() OVER (PARTITION BY sent_id, clause_i ORDER BY tail, depth, ord) AS INT), surface, reading, tail, true, false FROM made)"""

_GIVEN = "WITH RECURSIVE " + _LM + _costed(base._NODES)
_BEST = "SELECT k.sent_id, string_agg(s.surface, '' ORDER BY k.clause_i) AS surface FROM clause k JOIN strict s ON s.sent_id = k.sent_id AND s.clause_i = k.clause_i AND s.rank = 1 GROUP BY k.sent_id"

#: Lattices of the test sentences by the system dictionary.
_CUT = "list_filter(string_split(replace({0}, '。', '。' || chr(10)), chr(10)), lambda x: x <> '')"
_EVAL = (
    "WITH RECURSIVE "
    + _LM
    + ", "
    + _LINES_CTE
    + ", "
    + _SYSTEM
    + rf""",
pairs_of AS (SELECT CAST(item_id * 1000 + k AS BIGINT) AS sent_id, y[k + 1] AS yomi, s[k + 1] AS surface FROM (SELECT item_id, y, s, unnest(range(greatest(len(y), len(s)))) AS k FROM (SELECT item_id, {_CUT.format("yomi")} AS y, {_CUT.format("surface")} AS s FROM eval_item))),
texts AS (SELECT sent_id, yomi AS r FROM pairs_of WHERE yomi <> ''),
places AS (SELECT sent_id, r, unnest(range(len(r))) AS p FROM texts),
num AS (SELECT sent_id, p, regexp_extract(r[p + 1:], '^(?:0|[1-9][0-9]*)(?:\.[0-9]*)?') AS nn FROM places),
longest AS (SELECT max(len(yomi)) AS m FROM sysdict),
subs AS (SELECT sent_id, r, p, unnest(range(1, least(m, len(r) - p) + 1)) AS k FROM places, longest),
hits AS (SELECT DISTINCT sent_id, p, p + k AS e FROM subs JOIN sysdict ON sysdict.yomi = r[p + 1:p + k]),
steps AS (
  SELECT sent_id, p, p + len(nn) AS e FROM num WHERE nn <> ''
  UNION ALL SELECT h.sent_id, h.p, h.e FROM hits h JOIN num USING (sent_id, p) WHERE nn = ''
  UNION ALL SELECT num.sent_id, num.p, num.p + 1 FROM num ANTI JOIN hits USING (sent_id, p) WHERE nn = ''
), reach AS (SELECT sent_id, 0 AS p FROM texts UNION SELECT s.sent_id, s.e FROM reach JOIN steps s ON s.sent_id = reach.sent_id AND s.p = reach.p),
segs AS (SELECT DISTINCT s.sent_id, CAST(s.p AS INT) AS start_pos, CAST(s.e AS INT) AS end_pos, t.r[s.p + 1:s.e] AS yomi FROM steps s JOIN reach USING (sent_id, p) JOIN texts t USING (sent_id)),
cand AS (SELECT s.*, coalesce(list_filter(d.surfaces, lambda x: x <> ''), []) AS d, translate(s.yomi, '{base._HIRA}', '{base._KATA}') AS k FROM segs s LEFT JOIN sysdict d ON d.yomi = s.yomi),
listed AS (SELECT sent_id, start_pos, end_pos, yomi, list_concat(
    list_transform(d, lambda x: {{'s': x, 'a': false}}), CASE WHEN list_contains(d, yomi) THEN [] ELSE [{{'s': yomi, 'a': true}}] END,
    CASE WHEN list_contains(d, k) THEN [] ELSE [{{'s': k, 'a': true}}] END, CASE WHEN regexp_matches(yomi, '^[0-9]+') THEN [{{'s': '(*(*(NUMBER-KANSUJI', 'a': false}}] ELSE [] END) AS xs FROM cand),
len AS (SELECT sent_id, max(end_pos) AS l FROM segs GROUP BY sent_id),
every AS (
  SELECT sent_id, end_pos, start_pos, unnest(range(len(xs))) AS pos, yomi, unnest(xs) AS x FROM listed
  UNION ALL SELECT sent_id, 0, -1, 0, '__BOS__', {{'s': '__BOS__', 'a': false}} FROM len UNION ALL SELECT sent_id, l + 1, l, 0, '__EOS__', {{'s': '__EOS__', 'a': false}} FROM len),
enodes AS (SELECT sent_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY end_pos, start_pos, pos, encode(yomi), encode(x.s)) - 1 AS INT) AS node_idx, CAST(start_pos AS INT) AS start_pos, CAST(end_pos AS INT) AS end_pos, x.s AS surface, yomi, x.a AS auto_generated FROM every)"""
    + _costed("enodes")
)


def _lcs(source: str) -> str:
    """CTE common(id, n): longest common subsequences of a and b of `source` (id, a, b); a row of the table as state, its cells a running maximum."""
    return f"""
fold AS (
  SELECT id, a, string_split(b, '') AS bs, 0 AS k, list_transform(range(len(b) + 1), lambda x: 0) AS cells FROM {source} WHERE b <> '' AND a <> ''
  UNION ALL
  SELECT id, a, bs, k + 1, list_concat([0], list_transform(range(1, len(bs) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN bs[i] = a[k + 1] THEN cells[i] + 1 ELSE cells[i + 1] END)))) FROM fold WHERE k < len(a)),
common AS (SELECT id, cells[-1] AS n FROM fold WHERE k = len(a))"""


_ANNOTATED = (
    _USAGE
    + """,
wds AS (SELECT surface, min(yomi) AS reading FROM ufirst WHERE usage = 'Normal' AND surface <> '' GROUP BY surface),
docs AS (SELECT CAST(item_id AS BIGINT) AS sent_id, surface AS r FROM eval_item WHERE surface <> ''),
wlong AS (SELECT max(len(surface)) AS m FROM wds),
wsubs AS (SELECT sent_id, p, unnest(range(1, least(m, len(r) - p) + 1)) AS k, r FROM (SELECT sent_id, r, unnest(range(len(r))) AS p FROM docs), wlong),
best AS (SELECT sent_id, p, arg_max(wds.surface, len(wds.surface)) AS surface FROM wsubs JOIN wds ON wds.surface = r[p + 1:p + k] GROUP BY ALL),
scan AS (
  SELECT sent_id, r, 0 AS p, 0 AS i FROM docs
  UNION ALL SELECT c.sent_id, c.r, c.p + len(coalesce(b.surface, 'x')), c.i + 1 FROM scan c LEFT JOIN best b ON b.sent_id = c.sent_id AND b.p = c.p WHERE c.p < len(c.r)),
ann AS (SELECT c.sent_id, c.i, coalesce(b.surface, c.r[c.p + 1]) AS surface, coalesce(wds.reading, c.r[c.p + 1]) AS yomi FROM scan c LEFT JOIN best b ON b.sent_id = c.sent_id AND b.p = c.p LEFT JOIN wds ON wds.surface = b.surface WHERE c.p < len(c.r)),
annw AS (SELECT sent_id, i, surface || '/' || yomi AS word FROM ann),
annp AS (SELECT w1, w2, count(*) AS cnt FROM (SELECT lag(word) OVER (PARTITION BY sent_id ORDER BY i) AS w1, word AS w2 FROM annw) WHERE w1 IS NOT NULL GROUP BY ALL)"""
)

_EVAL_TRIM = base._TRIM.format("raw")
SQL = {
    "dictionaries_by_usage": f"WITH {_USAGE} SELECT usage, yomi, array_to_string(surfaces, '/') AS surfaces FROM udict",
    "system_dictionary": f"WITH {base._MERGE}, {_LINES_CTE}, {_SYSTEM} SELECT yomi, array_to_string(surfaces, '/') AS surfaces FROM sysdict",
    "missing_readings": f"WITH {_USAGE}, {_TOKENS} SELECT DISTINCT yomi FROM tk WHERE yomi <> '' AND yomi NOT IN (SELECT yomi FROM udict WHERE usage = 'Normal')",
    "system_keys": f"WITH {_USAGE} SELECT DISTINCT yomi FROM udict WHERE usage <> 'Disabled'",
    "eval_nodes": _EVAL + " SELECT sent_id, node_idx, start_pos, end_pos, surface, yomi, auto_generated, node_cost FROM n",
    "eval_converted": _EVAL + _DECODE + " " + _BEST,
    "eval_scores": _EVAL + _DECODE + f", got AS ({_BEST}), both_of AS (SELECT p.sent_id AS id, p.surface AS a, coalesce(got.surface, '') AS b FROM pairs_of p LEFT JOIN got USING (sent_id)), " + _lcs("both_of")
    + " SELECT count(*) FILTER (WHERE a = b) AS good, count(*) FILTER (WHERE a <> b) AS bad, round(100.0 * (SELECT sum(n) FROM common) / nullif(sum(len(b)), 0), 6) AS recall FROM both_of",
    "node_costs": _GIVEN + " SELECT sent_id, node_idx, word_id, node_cost FROM n",
    "lattice_edges": _GIVEN + " SELECT * FROM e",
    "lattice_decoded": _GIVEN + _DECODE + _COMPOUNDS + " SELECT sent_id, clause_i, rank, surface, yomi, round(cost, 6) AS cost, compound_word, on_path FROM decoded",
    "lattice_best": _GIVEN + _DECODE + " " + _BEST,
    "lattice_pages": _GIVEN + _DECODE + _COMPOUNDS + " SELECT sent_id, clause_i, rank, CAST((rank - 1) // 10 AS INT) AS page FROM decoded",
    "lattice_graphs": _GIVEN + """, l AS (SELECT sent_id, 0 AS k, node_idx AS o, format('n{} [label="{}/{}"]', node_idx, surface, yomi) AS line FROM n UNION ALL
  SELECT sent_id, 1, prev_idx, format('n{} -> n{} [label="{:.3f}"]', prev_idx, node_idx, edge_cost) FROM e)
  SELECT sent_id, 'digraph lattice {' || chr(10) || string_agg(line, chr(10) ORDER BY k, o, encode(line)) || chr(10) || '}' AS dot FROM l GROUP BY sent_id""",
    "teacher_pairs": f"WITH RECURSIVE {_ANNOTATED} SELECT w1, w2, cnt FROM annp",
    "learning_vocabulary": f"WITH RECURSIVE {base._MERGE}, {_ANNOTATED}, first AS (SELECT word, min((sent_id, i)) AS place FROM annw GROUP BY word), missing AS (SELECT * FROM first ANTI JOIN vocab USING (word)) SELECT word, word_id, cnt FROM vocab UNION ALL SELECT word, CAST(row_number() OVER (ORDER BY place) + (SELECT coalesce(max(word_id), 0) FROM vocab) AS INT), 1 FROM missing",
    "learned_unigrams": f"WITH RECURSIVE {base._MERGE}, {_ANNOTATED} SELECT word, word_id, vocab.cnt + coalesce(g.cnt, 0) AS cnt FROM vocab LEFT JOIN (SELECT word, count(*) AS cnt FROM annw GROUP BY word) g USING (word)",
    "learned_bigrams": f"WITH RECURSIVE {base._BIGRAMS}, {_ANNOTATED}, gain AS (SELECT a.word_id AS id1, b.word_id AS id2, p.cnt FROM annp p JOIN vocab a ON a.word = w1 JOIN vocab b ON b.word = w2) SELECT coalesce(big.id1, g.id1) AS id1, coalesce(big.id2, g.id2) AS id2, coalesce(big.cnt, 0) + coalesce(g.cnt, 0) AS cnt FROM big FULL JOIN gain g ON g.id1 = big.id1 AND g.id2 = big.id2",
    "word_overlap": f"WITH RECURSIVE {base._MERGE}, w AS (SELECT word AS id, split_part(word, '/', 1) AS a, substr(word, strpos(word, '/') + 1) AS b FROM kept), {_lcs('w')} SELECT w.id AS word, CAST(coalesce(n, 0) AS BIGINT) AS common FROM w LEFT JOIN common USING (id)",
    "unigram_dump": f"WITH {base._MERGE} SELECT word || ' ' || word_id || ' ' || CAST(CAST(round({_cost('cnt')}, 4) AS DECIMAL(10,4)) AS VARCHAR) AS line FROM vocab, stats UNION ALL SELECT '__TOTAL_WORDS__ ' || coalesce(t, 0) FROM stats UNION ALL SELECT '__UNIQUE_WORDS__ ' || u FROM stats",
    "passages_tokenized": f"WITH RECURSIVE {_ANNOTATED} SELECT sent_id, i, surface, yomi FROM ann",
    "distinct_annotated": f"WITH RECURSIVE {_ANNOTATED} SELECT sent_id, string_agg(yomi, '' ORDER BY i) AS yomi, string_agg(surface, '' ORDER BY i) AS surface, count(DISTINCT (surface, yomi)) AS words FROM ann GROUP BY sent_id",
    "document_lines_judged": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS raw FROM l), t AS (SELECT doc_id, line_no, {_EVAL_TRIM} AS t FROM f) SELECT doc_id, line_no, CASE WHEN contains(t, ' ') THEN replace(t[:strpos(t, ' ') - 1], '|', '') END AS yomi, CASE WHEN contains(t, ' ') THEN replace(t[strpos(t, ' ') + 1:], '|', '') END AS surface, CASE WHEN NOT contains(t, ' ') THEN 'no blank' END AS reason FROM t WHERE t <> '' AND NOT starts_with(t, '#')",
}
