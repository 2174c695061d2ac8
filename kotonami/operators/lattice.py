"""Word lattices as tables: segments, nodes, edges and their costs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.functions.text import hira2kata, word_key
from kotonami.operators.costs import smoothed_cost
from kotonami.operators.dictionary import prefix_hits

BOS, EOS = "__BOS__", "__EOS__"


def _reachable(text: str, found: dict[int, list[int]], ranges: list[tuple[int, int]], number) -> list[tuple[int, int]]:
    """(start, end) of segments that can be reached from the beginning."""
    starts = {a: b for a, b in ranges}
    out: list[tuple[int, int]] = []
    todo, seen = [0], set()
    while todo:
        at = todo.pop()
        if at in seen or at >= len(text):
            continue
        seen.add(at)
        if at in starts:
            ends = [starts[at]]
        elif any(a <= at < b for a, b in ranges):
            continue
        elif m := number.match(text, at):
            ends = [m.end()]
        else:
            ends = [e for e in found.get(at, []) if not any(a <= e <= b for a, b in ranges)] or [at + 1]
        out += [(at, e) for e in ends]
        todo += ends
    return sorted(set(out))


def segments(readings: DataFrame, keys: DataFrame, max_length: int | None = None) -> DataFrame:
    """(sent_id, start_pos, end_pos, yomi): the segments of readings (sent_id, yomi, optional force_ranges).

    From each position that can be reached: a forced range is the only segment; a number is
    the only segment; else every key that begins there and doesn't end within a forced range;
    where there is none, the one character. Empty and null readings give no row.
    """
    texts = readings.select("sent_id", F.col("yomi").alias("reading"), (F.col("force_ranges") if "force_ranges" in readings.columns else F.lit(None).cast("array<struct<start:int,end:int>>")).alias("force_ranges")).where("reading <> ''")
    hits = prefix_hits(texts.select("sent_id", "reading"), keys, max_length=max_length).groupBy("sent_id").agg(F.collect_set(F.struct("start_pos", (F.col("start_pos") + F.length("key")).alias("end_pos"))).alias("hits"))
    both = texts.join(hits, "sent_id", "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        number = re.compile(r"(?:0|[1-9][0-9]*)(?:\.[0-9]*)?")
        for pdf in batches:
            rows = []
            for sid, text, hits, ranges in zip(pdf.sent_id, pdf.reading, pdf.hits, pdf.force_ranges):
                found: dict[int, list[int]] = {}
                for h in hits if hits is not None else ():
                    found.setdefault(h["start_pos"], []).append(h["end_pos"])
                forced = [(r["start"], r["end"]) for r in ranges] if ranges is not None else []
                rows += [(sid, a, b, text[a:b]) for a, b in _reachable(text, found, forced, number)]
            yield pd.DataFrame(rows, columns=["sent_id", "start_pos", "end_pos", "yomi"])

    kind = readings.schema["sent_id"].dataType.simpleString()
    return both.mapInPandas(walk, f"sent_id {kind}, start_pos INT, end_pos INT, yomi STRING")


def _tagged(surfaces: Column, branch: int) -> Column:
    return F.transform(surfaces, lambda x: F.struct(x.alias("surface"), F.lit(branch).alias("branch")))


def nodes(segs: DataFrame, dictionary: DataFrame, user: DataFrame | None = None, single: DataFrame | None = None) -> DataFrame:
    """(sent_id, node_idx, start_pos, end_pos, surface, yomi, auto_generated) of segments.

    In order: dictionary candidates, those of the user that aren't among them, the reading and
    its katakana where neither has them, a number in kanji for digits, candidates of whole
    readings. Sentinels stand at both ends. `node_idx` numbers a sentence's nodes by position
    and this order.
    """
    empty = segs.sparkSession.createDataFrame([], "yomi STRING, surfaces ARRAY<STRING>")
    user, single = user if user is not None else empty, single if single is not None else empty
    span = segs.select("sent_id", "start_pos", "end_pos", "yomi")
    whole = span.groupBy("sent_id").agg(F.max("end_pos").alias("length"))
    joined = span.join(dictionary.select("yomi", F.array_distinct("surfaces").alias("d")), "yomi", "left").join(user.select("yomi", F.array_distinct("surfaces").alias("u")), "yomi", "left")
    joined = joined.join(single.select("yomi", F.col("surfaces").alias("s")), "yomi", "left").join(whole, "sent_id")
    none = F.array().cast("array<string>")
    d = F.filter(F.coalesce("d", none), lambda x: x != "")
    own = F.array_except(F.filter(F.coalesce("u", none), lambda x: x != ""), d)
    known = F.concat(d, own)
    auto = F.filter(F.array(F.col("yomi"), hira2kata(F.col("yomi"))), lambda x: ~F.array_contains(known, x))
    number = F.when(F.col("yomi").rlike("^[0-9]+"), F.array(F.lit("(*(*(NUMBER-KANSUJI"))).otherwise(none)
    lone = F.when((F.col("start_pos") == 0) & (F.col("end_pos") == F.col("length")), F.coalesce("s", none)).otherwise(none)
    tagged = [_tagged(a, b) for b, a in enumerate((d, own, auto, number, lone))]
    rows = joined.select("sent_id", "start_pos", "end_pos", "yomi", F.posexplode(F.concat(*tagged)).alias("pos", "x"))
    body = rows.select("sent_id", "start_pos", "end_pos", "yomi", F.col("x.surface").alias("surface"), (F.col("x.branch") == 2).alias("auto_generated"), "pos")
    ends = whole.select("sent_id", F.explode(F.array(*[F.struct(a.cast("int").alias("start_pos"), b.cast("int").alias("end_pos"), F.lit(n).alias("yomi"), F.lit(n).alias("surface"), F.lit(False).alias("auto_generated"), F.lit(0).alias("pos")) for n, a, b in ((BOS, F.lit(-1), F.lit(0)), (EOS, F.col("length"), F.col("length") + 1))])).alias("e"))
    every = body.unionByName(ends.select("sent_id", "e.*"))
    lists = every.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("end_pos", "start_pos", "pos", "yomi", "surface", "auto_generated"))).alias("ns"))
    return lists.select("sent_id", F.posexplode("ns").alias("node_idx", "n")).select("sent_id", "node_idx", "n.start_pos", "n.end_pos", "n.surface", "n.yomi", "n.auto_generated")


def with_unigram(node: DataFrame, lm: DataFrame) -> DataFrame:
    """Nodes with word_id and score of 'surface/yomi'; null where unknown or generated."""
    words = lm.select(F.col("word").alias("_w"), "word_id", F.col("cost").alias("score"))
    joined = node.withColumn("_key", word_key(F.col("surface"), F.col("yomi"))).join(words, F.col("_key") == F.col("_w"), "left").drop("_w", "_key")
    return joined.withColumn("word_id", F.when(~F.col("auto_generated"), F.col("word_id"))).withColumn("score", F.when(~F.col("auto_generated"), F.col("score")))


def node_cost(surface: Column, yomi: Column, score: Column, user_cost: Column, total: Column, unique: Column) -> Column:
    """The user's cost, else the model's, else that of one count for shortening words and of none for others."""
    return F.coalesce(user_cost, score, F.when(F.octet_length(surface) < F.octet_length(yomi), smoothed_cost(F.lit(1), total, unique)).otherwise(smoothed_cost(F.lit(0), total, unique)))


def adjacent(node: DataFrame, columns: list[str]) -> DataFrame:
    """(sent_id, prev_idx, node_idx, prev_*, columns): nodes that meet, by an equi-join on sentence and position."""
    left = node.select("sent_id", F.col("node_idx").alias("prev_idx"), F.col("end_pos").alias("_at"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    right = node.select("sent_id", "node_idx", F.col("start_pos").alias("_at"), *columns)
    return left.join(right, ["sent_id", "_at"]).where("prev_idx <> node_idx").drop("_at")


def known_edges(node: DataFrame, bigram: DataFrame, user_bigram: DataFrame | None = None) -> DataFrame:
    """(sent_id, prev_idx, node_idx, edge_cost) of the edges that the user's pairs (key, cost) or the model (id1, id2, cost) know; all others cost the default."""
    met = adjacent(node.withColumn("key", word_key(F.col("surface"), F.col("yomi"))), ["word_id", "key"])
    lm = bigram.select(F.col("id1").alias("prev_word_id"), F.col("id2").alias("word_id"), F.col("cost").alias("lm_cost"))
    out = met.join(lm, ["prev_word_id", "word_id"], "left")
    if user_bigram is not None:
        own = user_bigram.select(F.col("key").alias("pair"), F.col("cost").alias("user_cost"))
        out = out.withColumn("pair", F.concat("prev_key", F.lit("\t"), "key")).join(own, "pair", "left")
    else:
        out = out.withColumn("user_cost", F.lit(None).cast("double"))
    return out.select("sent_id", "prev_idx", "node_idx", F.coalesce("user_cost", "lm_cost").alias("edge_cost")).where("edge_cost is not null")


def edges(node: DataFrame, bigram: DataFrame, default_cost: float, user_bigram: DataFrame | None = None) -> DataFrame:
    """(sent_id, prev_idx, node_idx, edge_cost): the user's cost, else the model's for two known words, else the default."""
    known = known_edges(node, bigram, user_bigram)
    return adjacent(node, []).join(known, ["sent_id", "prev_idx", "node_idx"], "left").select("sent_id", "prev_idx", "node_idx", F.coalesce("edge_cost", F.lit(float(default_cost))).alias("edge_cost"))


def same_span(node: DataFrame) -> DataFrame:
    """Nodes with the others of their span: (sent_id, start_pos, end_pos, surfaces) in order of node_idx."""
    lists = node.groupBy("sent_id", "start_pos", "end_pos").agg(F.sort_array(F.collect_list(F.struct("node_idx", "surface"))).alias("s"))
    return lists.select("sent_id", "start_pos", "end_pos", F.transform("s", lambda x: x["surface"]).alias("surfaces"))


def dot_graph(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(sent_id, dot): a graph description of a lattice."""
    labels = node.select("sent_id", F.col("node_idx").alias("o"), F.lit(0).alias("k"), F.format_string('n%d [label="%s/%s"]', "node_idx", "surface", "yomi").alias("line"))
    arrows = edge.select("sent_id", F.col("prev_idx").alias("o"), F.lit(1).alias("k"), F.format_string('n%d -> n%d [label="%.3f"]', "prev_idx", "node_idx", "edge_cost").alias("line"))
    lists = labels.unionByName(arrows).groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("k", "o", "line"))).alias("l"))
    return lists.select("sent_id", F.concat(F.lit("digraph lattice {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("dot"))
