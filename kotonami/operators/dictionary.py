"""Kana-kanji dictionaries: parsing, okuri expansion, merging, checks and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonami.functions.romaji import okuri_table
from kotonami.functions.text import kata2hira

OKURI_ARI, OKURI_NASI = ";; okuri-ari entries.", ";; okuri-nasi entries."
BLANK = chr(0x3000)
KATAKANA_RUN = r"^[゠-ヿ]+"


def entry_surfaces(packed: Column) -> Column:
    """Candidates of a field '/a/b;note/': notes dropped, empty ones too."""
    bare = F.transform(F.split(F.regexp_replace(packed, r"\A/+|/+\z", ""), "/", -1), lambda x: F.regexp_replace(x, "(?s);.*", ""))
    return F.filter(bare, lambda x: x != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(src_rank, section, yomi, surfaces) of dictionary lines (src_rank, line_no, line).

    Lines before any header are okuri-ari. Empty lines, comments and readings that begin with a
    Latin letter give nothing; of a reading that comes again in its section the last one holds.
    """
    own = Window.partitionBy("src_rank").orderBy("line_no")
    header = F.when(F.col("line") == OKURI_ARI, "ari").when(F.col("line") == OKURI_NASI, "nasi")
    marked = lines.where("line is not null").withColumn("section", F.coalesce(F.last(header, ignorenulls=True).over(own), F.lit("ari")))
    body = marked.where((F.col("line") != "") & ~F.col("line").startswith(";;") & ~F.col("line").rlike("^[A-Za-z]") & F.col("line").contains(" "))
    rows = body.select("src_rank", "section", "line_no", F.substring_index("line", " ", 1).alias("yomi"), entry_surfaces(F.expr("substring(line, locate(' ', line) + 1)")).alias("surfaces"))
    return last_entries(rows, ["src_rank", "section", "yomi"], "line_no")


def last_entries(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several entries under one key, the last."""
    return rows.groupBy(*keys).agg(F.max_by("surfaces", order).alias("surfaces"))


def expand_okuri(entries: DataFrame) -> DataFrame:
    """Entries with an okuri letter at the end of the reading, spelled out; others as they are.

    A vowel letter is its kana; a consonant gives an entry for each vowel that it takes. A
    Latin letter that stands for no kana gives no entry.
    """
    letters = okuri_table(entries.sparkSession).toDF("_letter", "_kana")
    last = F.regexp_extract("yomi", "([A-Za-z])$", 1)
    joined = entries.withColumn("_last", last).join(F.broadcast(letters), F.col("_last") == F.col("_letter"), "left").where("_last = '' or _kana is not null")
    kana = F.coalesce("_kana", F.lit(""))
    stem = F.when(F.col("_last") == "", F.col("yomi")).otherwise(F.expr("left(yomi, length(yomi) - 1)"))
    return joined.withColumn("yomi", F.concat(stem, kana)).withColumn("surfaces", F.transform("surfaces", lambda s: F.concat(s, kana))).drop("_last", "_letter", "_kana")


def to_rows(dictionary: DataFrame, *more: str) -> DataFrame:
    """One row a candidate: (more, yomi, pos, surface)."""
    return dictionary.select(*more, "yomi", F.posexplode("surfaces").alias("pos", "surface"))


def merged(rows: DataFrame) -> DataFrame:
    """(yomi, surfaces) of candidates (src_rank, pos, yomi, surface): each once, where it comes first.

    The distinct candidates are found before any list is made, so a list holds no repeats.
    """
    first = rows.groupBy("yomi", "surface").agg(F.min(F.struct("src_rank", "pos")).alias("at"))
    lists = first.groupBy("yomi").agg(F.sort_array(F.collect_list(F.struct("at", "surface"))).alias("s"))
    return lists.select("yomi", F.transform("s", lambda x: x["surface"]).alias("surfaces"))


def merge_dictionaries(dictionaries: list[DataFrame]) -> DataFrame:
    """Dictionaries (yomi, surfaces) in order of precedence, merged."""
    return merged(reduce(DataFrame.unionByName, [to_rows(d).withColumn("src_rank", F.lit(i)) for i, d in enumerate(dictionaries)]))


def grouped(rows: DataFrame, order: list[str]) -> DataFrame:
    """(yomi, surfaces): all candidates of a reading in order, repeats too."""
    lists = rows.groupBy("yomi").agg(F.sort_array(F.collect_list(F.struct(*order, "surface"))).alias("s"))
    return lists.select("yomi", F.transform("s", lambda x: x["surface"]).alias("surfaces"))


def from_vocabulary(vocab: DataFrame) -> DataFrame:
    """(word, yomi, surface) of words 'surface/yomi'; a word without a slash is an error, unknown and blank ones go."""
    checked = vocab.select(F.when(F.col("word").contains("/"), F.col("word")).otherwise(F.raise_error(F.concat(F.lit("no slash: "), F.col("word")))).alias("word"))
    rows = checked.select("word", F.split("word", "/", 2)[1].alias("yomi"), F.split("word", "/", 2)[0].alias("surface"))
    return rows.where((F.col("yomi") != "UNK") & (F.col("yomi") != "") & ~F.col("yomi").contains(BLANK) & ~F.col("surface").contains(BLANK))


def from_unidic(rows: DataFrame) -> DataFrame:
    """(yomi, surfaces) of katakana words in a word list of at least 11 columns `c`; the last one holds."""
    good = rows.where((F.size("c") >= 11) & F.get("c", F.lit(0)).rlike(KATAKANA_RUN) & (F.get("c", F.lit(0)) == F.get("c", F.lit(10))))
    return good.select(kata2hira(F.get("c", F.lit(0))).alias("yomi"), F.array(F.get("c", F.lit(0))).alias("surfaces"), "line_no").groupBy("yomi").agg(F.max_by("surfaces", "line_no").alias("surfaces"))


def cleaned(dictionary: DataFrame) -> DataFrame:
    """Without candidates that are a full-width blank."""
    return dictionary.withColumn("surfaces", F.array_remove("surfaces", BLANK))


def violations(dictionary: DataFrame) -> DataFrame:
    """(yomi, surface, problem) of rows that a system dictionary must not hold."""
    rows = to_rows(dictionary)
    problem = (
        F.when(F.col("yomi") == "", "empty yomi")
        .when(F.col("surface") == "", "empty surface")
        .when(F.col("yomi").contains(BLANK), "blank in yomi")
        .when((F.col("yomi") == "い") & ((F.length("surface") > 1) | (F.col("surface") == "好い")), "surface longer than yomi")
    )
    return rows.select("yomi", "surface", problem.alias("problem")).where("problem is not null")


def missing_keys(dictionary: DataFrame, required: list[str]) -> DataFrame:
    """Readings that must exist and don't."""
    need = dictionary.sparkSession.createDataFrame([(y,) for y in required], "yomi STRING")
    return need.join(dictionary.select("yomi"), "yomi", "left_anti")


def in_known_characters(dictionary: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """`dictionary` (yomi, surfaces) without candidates that hold a character which no text has, such as those of a wrong decoding.

    Tables of characters are bounded by the alphabet, so they are broadcast. Readings that lose all candidates go.
    """
    characters = lambda df, c: df.select(F.explode(F.array_distinct(F.split(c, ""))).alias("ch")).distinct()
    rows = to_rows(dictionary)
    surfaces = rows.select("surface").distinct()
    strange = characters(surfaces, "surface").join(F.broadcast(characters(texts.where(F.col(text).isNotNull()), text)), "ch", "left_anti")
    bad = surfaces.select("surface", F.explode(F.array_distinct(F.split("surface", ""))).alias("ch")).join(F.broadcast(strange), "ch", "left_semi").select("surface").distinct()
    return grouped(rows.join(bad, "surface", "left_anti"), ["pos"])


def first_uses(rows: DataFrame) -> DataFrame:
    """(yomi, surfaces) of annotated words (sent_id, i, yomi, surface): each candidate once, in order of its first use."""
    first = rows.where("yomi <> '' and surface <> ''").groupBy("yomi", "surface").agg(F.min(F.struct("sent_id", "i")).alias("at"))
    return grouped(first, ["at"])


def system_dictionary(base: DataFrame, vocab: DataFrame, corpus_rows: DataFrame, unidic: DataFrame) -> DataFrame:
    """The base dictionary, the vocabulary, annotated corpora (sent_id, i, yomi, surface) and katakana words, merged in this order.

    A candidate list holds distinct candidates at every step, however often the corpora use them.
    """
    return merge_dictionaries([cleaned(base), grouped(from_vocabulary(vocab), ["word"]), first_uses(corpus_rows), unidic])


def of_usage(entries: DataFrame, configs: DataFrame, usage: str) -> DataFrame:
    """Entries (dict_id, ...) of the dictionaries that are configured for `usage`: Normal, SingleTerm or Disabled, in any case; none is Disabled.

    A dictionary type other than SKK is an error.
    """
    kind = F.upper(F.trim(F.coalesce("dict_type", F.lit("SKK"))))
    known = configs.where(F.lower(F.trim(F.coalesce("usage", F.lit("Disabled")))) == usage.lower())
    known = known.select("dict_id", F.when(kind == "SKK", True).otherwise(F.raise_error(F.concat(F.lit("unknown dictionary type: "), kind)).cast("boolean")).alias("_known"))
    return entries.join(F.broadcast(known.where("_known").select("dict_id")), "dict_id", "left_semi")


def prefix_hits(readings: DataFrame, keys: DataFrame, reading: str = "reading", max_length: int | None = None) -> DataFrame:
    """`readings` joined with every key that stands at some position: (..., start_pos, key).

    Substrings up to the longest key meet the keys in an equi-join, no theta join. Positions
    count code points from 0.
    """
    longest = max_length or keys.agg(F.coalesce(F.max(F.length("yomi")), F.lit(1))).first()[0]
    n = F.length(reading)
    at = readings.where(n > 0).withColumn("start_pos", F.explode(F.sequence(F.lit(0), n - 1)))
    subs = at.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start_pos"))), lambda k: F.substring(F.col(reading), F.col("start_pos") + 1, k))))
    return subs.join(keys.select(F.col("yomi").alias("key")).distinct(), "key", "left_semi")


def predictive_hits(dictionary: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Readings that begin with `prefix`, all or the first ones in order; the filter reaches the scan."""
    hits = dictionary.select("yomi").where(F.col("yomi").startswith(prefix)).distinct()
    return hits if limit is None else hits.orderBy("yomi").limit(limit)


def continuations(dictionary: DataFrame, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(prefix, yomi) of every distinct prefix and every reading that begins with it; the empty prefix begins all, null none.

    Beginnings of readings up to the longest prefix meet the prefixes in an equi-join, no theta join.
    """
    wanted = prefixes.select(F.col(prefix).alias("prefix")).where("prefix is not null").distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
    readings = dictionary.select("yomi").where("yomi is not null").distinct()
    begun = readings.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("yomi"))), lambda k: F.substring("yomi", F.lit(1), k))))
    return begun.join(wanted, "prefix").select("prefix", "yomi")
