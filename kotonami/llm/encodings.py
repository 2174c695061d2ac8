"""Garbled text from wrong character encodings: EM over latent encoding chains per source and field.

An item of text was written in one encoding and decoded in another, at times twice; the
chain is latent. For every distinct item the likelihood under each chain is the probability
of its inverse (the text that the chain would have garbled so) under a model of sound text:
characters by class, or a known word where the text is an item of other records, the surer
the more records have it. Bytes that a lossy decoding dropped cost a factor each. The E-step gives each item its posterior
over chains; the M-step sets the share of each chain in every (source, field), with a common
prior, so that records which say little by themselves borrow from others of their source.
Each record is then repaired by posterior, where its inverse lost nothing.

Only items that some chain could have made take part one by one; EM runs on their classes of
likelihoods by source and field, to convergence. No probability depends on the size of the corpus:
records of other sources and words don't change the judgement of a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.runtime import cut_lineage

#: Written in the first encoding, decoded in the second (and so on); 'western' stands for latin-1 and cp1252 alike.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "sound": (),
    "utf-8 as western": (("utf-8", "western"),),
    "utf-8 as western, twice": (("utf-8", "western"), ("utf-8", "western")),
    "cp932 as western": (("cp932", "western"),),
    "euc_jp as western": (("euc_jp", "western"),),
    "utf-8 as cp932": (("utf-8", "cp932"),),
    "euc_jp as cp932": (("euc_jp", "cp932"),),
    "cp932 as utf-8": (("cp932", "utf-8"),),
    "euc_jp as utf-8": (("euc_jp", "utf-8"),),
    "utf-8 as euc_jp": (("utf-8", "euc_jp"),),
    "cp932 as euc_jp": (("cp932", "euc_jp"),),
}
#: An item that n other records have, from KNOWN_LEAST on, has the probability n / (n + KNOWN_HALF) / VOCABULARY of a known word, whatever the size of the corpus.
KNOWN_LEAST, KNOWN_HALF, VOCABULARY = 3, 100, 500
#: EM ends when no share moves by more than this, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 500
#: Classes of likelihoods in EM: steps in nats, and what is further from the likeliest chain counts as this far.
#: So a source has few classes, however many items: most items have two or three chains nearer than that.
STEP, FAR_CLASS = 0.5, -40.0
#: A chain further than this from the likeliest, in nats, has no weight, even if its text is a known word.
HOPELESS = 45.0
#: Shares of no more (source, field) than this are broadcast, of about 100 bytes each.
BROADCAST_SOURCES = 50_000
LOST = chr(0xFFFD)
#: Of chains without an inverse, and of soundness for an item with U+FFFD, for which UTF-8 read wrongly always has one.
IMPOSSIBLE = float("-inf")
_LOST_COST, _BROKEN_COST, _END_COST = log(2e-3), log(1e-9), log(1e-5)
#: An item whose characters alone call it garbled by this much is no known word: a garbled note can be frequent too.
_FAR = log(1e8)
#: A letter of the Latin alphabet beside a kanji or kana in one word.
_MIXED_COST = log(3e-2)
#: Probabilities of one character of each class in sound text.
CLASS_COST = {k: log(v) for k, v in {"kana": 4e-3, "kanji": 2e-4, "rare kanji": 3e-6, "ascii": 1e-3, "half kana": 2e-5, "accented": 1e-4, "capital accented": 1e-5, "symbol": 2e-5, "other": 2e-7, "odd": 1e-14}.items()}
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def char_class(ch: str) -> str:
    o = ord(ch)
    if 0x20 <= o < 0x7F:
        return "ascii"
    if 0x3041 <= o <= 0x30FF:
        return "kana"
    if 0x4E00 <= o <= 0x9FFF or o in (0x3005, 0x3007):
        try:
            lead = ch.encode("euc_jp")
        except UnicodeEncodeError:
            return "rare kanji"
        return "kanji" if len(lead) == 2 and lead[0] < 0xD0 else "rare kanji"
    if 0xFF61 <= o <= 0xFF9F:
        return "half kana"
    if o < 0xA0 or o == 0xAD or 0xE000 <= o <= 0xF8FF or o in (0xFFFD, 0xFEFF) or 0xD800 <= o < 0xE000:
        return "odd"
    if 0xC0 <= o <= 0x24F and o not in (0xD7, 0xF7):
        return "capital accented" if ch.isupper() else "accented"
    if o < 0xC0 or o in (0xD7, 0xF7) or 0x391 <= o <= 0x3C9 or 0x410 <= o <= 0x44F or 0x2010 <= o <= 0x27BF or 0x3000 <= o <= 0x33FF or 0xFF01 <= o <= 0xFF5E or 0x1F300 <= o <= 0x1FAFF:
        return "symbol"
    return "other"


class Scorer:
    """Log-likelihoods of an item under every chain, by characters."""

    def __init__(self):
        self.cost: dict[str, float] = {}

    def text(self, text: str) -> float:
        """Log-probability of sound text."""
        total = _END_COST if len(text) == 0 else 0.0
        for ch in text:
            c = self.cost.get(ch)
            if c is None:
                c = self.cost[ch] = CLASS_COST[char_class(ch)]
            total += c
        if any("a" <= ch <= "z" for ch in text) and not text.isascii():
            total += _MIXED_COST * sum((a.isascii() and a.isalpha()) != (b.isascii() and b.isalpha()) and ord(max(a, b)) > 0x2FF for a, b in zip(text, text[1:]))
        return total

    def readings(self, item: str, within: float = HOPELESS) -> tuple[float, list[tuple[int, str, float, float]]]:
        """The score of the item as it is, and (chain, text before it, score of that text, cost of losses) of each chain that could have made it.

        Plain ASCII reads alike in all these encodings. Chains further than `within` from the likeliest are left out.
        """
        own = IMPOSSIBLE if LOST in item else self.text(item)
        if item.isascii():
            return own, []
        found = []
        for k, steps in enumerate(CHAINS.values()):
            text, cost = item, 0.0
            for written, read in reversed(steps):
                text, more = inverse(text, written, read)
                cost += more
                if text is None:
                    break
            # no fixed floor: a sum over a long item is far below any; but losses may rule a chain out before its text is looked at
            if steps and text is not None and (text != item or LOST in item) and cost - log(VOCABULARY) >= own - within:
                before = text.replace(LOST, "")
                found.append((k, before, self.text(before), cost))
        best = max([own, *(s + c for _, _, s, c in found)])
        return own, [f for f in found if max(f[2], -log(VOCABULARY)) + f[3] > best - within]

    def scores(self, item: str) -> list[float]:
        own, found = self.readings(item, float("inf"))
        return [own] + [next((s + c for j, _, s, c in found if j == k), IMPOSSIBLE) for k in range(1, len(CHAINS))]


def inverse(text: str, written: str, read: str) -> tuple[str | None, float]:
    """The text that `written` bytes read as `read` would have been, U+FFFD where bytes are lost, and the cost of losses."""
    data = bytearray()
    lossy = LOST in text
    cost = 0.0
    for ch in text:
        if ch == LOST:
            data.append(0xFF)  # no text of any of these encodings has this byte
        elif read == "western":
            if ord(ch) < 256:
                data.append(ord(ch))
            elif ch in _CP1252:
                data.append(_CP1252[ch])
            else:
                return None, 0.0
        else:
            try:
                data += ch.encode(read)
            except UnicodeEncodeError:
                return None, 0.0
    back = bytes(data).decode(written, "replace")
    losses = back.count(LOST)
    if losses:
        if lossy:
            cost += losses * _LOST_COST
        else:  # only the end may have been cut off
            cost += (losses - 1) * _BROKEN_COST + (_END_COST if back.endswith(LOST) else _BROKEN_COST)
    return back, cost


def repaired(item: str, chain: str) -> str | None:
    """The item before the chain; null where something is lost."""
    text: str | None = item
    for written, read in reversed(CHAINS[chain]):
        text, _ = inverse(text, written, read)
        if text is None or LOST in text:
            return None
    return text


def packed_items(rows: DataFrame) -> DataFrame:
    """(key, h, source, pos, field, item) of rows (key, h, source, packed): candidates between slashes, and their notes after `;`."""
    parts = rows.select("key", "h", "source", F.posexplode(F.split("packed", "/", -1)).alias("pos", "part"))
    note = F.when(F.col("part").contains(";"), F.expr("substring(part, locate(';', part) + 1)"))
    fields = F.array(F.struct(F.lit("candidate").alias("field"), F.substring_index("part", ";", 1).alias("item")), F.struct(F.lit("note").alias("field"), note.alias("item")))
    return parts.select("key", "h", "source", "pos", F.explode(fields).alias("f")).select("key", "h", "source", "pos", "f.field", "f.item").where("item is not null and item <> ''")


def _known(n: Column) -> Column:
    """Log-probability of a word that `n` records have."""
    return F.when(n >= KNOWN_LEAST, F.log(n / (n + KNOWN_HALF)) - log(VOCABULARY)).otherwise(F.lit(IMPOSSIBLE))


def _likelihoods(counts: DataFrame) -> DataFrame:
    """(item, ll) of the items of counts (item, n) that some chain could have made: their log-likelihoods under every chain."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer()
        kind = pa.list_(pa.struct([("chain", pa.int32()), ("text", pa.string()), ("score", pa.float64()), ("cost", pa.float64())]))
        for batch in batches:
            read = [scorer.readings(x) for x in batch.column("item").to_pylist()]
            ok = [own > max((s + c for _, _, s, c in found), default=IMPOSSIBLE) - _FAR for own, found in read]
            alts = [[{"chain": k, "text": t, "score": s, "cost": c} for k, t, s, c in found] for _, found in read]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own for own, _ in read], pa.float64()), pa.array(ok, pa.bool_()), pa.array(alts, kind)], names=["item", "n", "own", "ok", "alts"])

    scored = cut_lineage(counts.mapInArrow(score, "item STRING, n BIGINT, own DOUBLE, ok BOOLEAN, alts ARRAY<STRUCT<chain: INT, text: STRING, score: DOUBLE, cost: DOUBLE>>"))
    words = scored.where("ok").select(F.col("item").alias("text"), F.col("n").alias("known"))
    suspects = scored.where("size(alts) > 0 or own = double('-infinity')").select("item", "n", "own", "ok", "alts")
    one = suspects.select("item", "n", "own", "ok", F.explode_outer("alts").alias("a")).select("item", "n", "own", "ok", "a.*").join(words, "text", "left")
    value = F.greatest("score", _known(F.coalesce("known", F.lit(0)))) + F.col("cost")
    impossible = F.lit(IMPOSSIBLE)
    each = [F.coalesce(F.max(F.when(F.col("chain") == k, value)), impossible) for k in range(1, len(CHAINS))]
    # the garbled form of a word is rarer than the word: no known word by itself
    by_itself = F.max("ok") & (F.coalesce(F.max("known"), F.lit(0)) < F.max("n"))
    own = F.when(by_itself, F.greatest(F.max("own"), _known(F.max("n") - 1))).otherwise(F.max("own"))
    return cut_lineage(one.groupBy("item").agg(F.array(own, *each).alias("ll")))


def chain_posteriors(items: DataFrame, prior: float = 4.0) -> DataFrame:
    """(source, field, item, chain, p_sound) of the distinct items that some chain could have made: the likeliest one and the posterior of soundness.

    `items` has source, field and item; a null source is a source of its own. Items that are not
    among the rows are sound.
    """
    n_chains = len(CHAINS)
    counts = cut_lineage(items.groupBy("source", "field", "item").agg(F.count("*").alias("n")))
    ll = _likelihoods(counts.groupBy("item").agg(F.sum("n").alias("n")))
    suspects = cut_lineage(counts.join(ll, "item"))
    start = [0.9] + [0.1 / (n_chains - 1)] * (n_chains - 1)
    topped = suspects.select("source", "field", "item", "n", "ll", F.array_max("ll").alias("top"))
    classed = topped.select("source", "field", "n", F.transform("ll", lambda x: F.greatest(F.round((x - F.col("top")) / STEP) * STEP, F.lit(FAR_CLASS))).alias("ll"))
    classed = classed.groupBy("source", "field", "ll").agg(F.sum("n").alias("n"))
    # items that no chain could have made are one class more
    plain = counts.join(ll.select("item"), "item", "left_anti").groupBy("source", "field").agg(F.sum("n").alias("n"))
    plain = plain.select("source", "field", F.array(F.lit(0.0), *[F.lit(FAR_CLASS)] * (n_chains - 1)).alias("ll"), "n")

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        weight, n, share = np.exp(np.stack(pdf.ll)), pdf.n.to_numpy(float), np.array(start)
        for _ in range(ROUNDS):
            joint = weight * share
            new = n @ (joint / joint.sum(1, keepdims=True)) + prior * np.array(start)
            new, old = new / new.sum(), share
            share = new
            if np.abs(new - old).max() <= TOLERANCE:
                break
        return pdf[["source", "field"]].head(1).rename(columns={"source": "s", "field": "f"}).assign(share=[share.tolist()])

    kind = items.schema["source"].dataType.simpleString()
    shares = cut_lineage(classed.unionByName(plain).groupBy("source", "field").applyInPandas(em, f"s {kind}, f STRING, share ARRAY<DOUBLE>"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))
    small = shares.count() <= BROADCAST_SOURCES

    def beside(rows: DataFrame, now: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(now) if small else now, same)

    # each weight is computed once, in a projection of its own
    weighted = beside(topped, shares).select("source", "field", "item", F.zip_with("ll", "share", lambda x, s: s * F.exp(x - F.col("top"))).alias("w"))
    judged = weighted.select("source", "field", "item", "w", F.aggregate("w", F.lit(0.0), lambda t, x: t + x).alias("total"))
    sound = F.get("w", F.lit(0)) / F.col("total")
    others = F.slice("w", 2, n_chains)
    best = F.get(F.array(*[F.lit(c) for c in list(CHAINS)[1:]]), F.array_position(others, F.array_max(others)).cast("int") - 1)
    return judged.select("source", "field", "item", F.when(sound >= 0.5, F.lit("sound")).otherwise(best).alias("chain"), sound.alias("p_sound"))


def repaired_records(df: DataFrame, key: str, source: str, packed: str) -> DataFrame:
    """(key, garbled, recovered, repaired) of every record with a field.

    `garbled`: an item of it is; `recovered`: all its garbled items could be restored without
    loss; `repaired`: the field with these restored and the others as they are. Null and empty
    fields give no row; rows that are alike give one, rows with other fields under one key each their own.
    """
    rows = df.select(df[key].alias("key"), df[source].alias("source"), df[packed].alias("packed")).where("packed is not null and packed <> ''").distinct()
    rows = rows.withColumn("h", F.xxhash64("source", "packed"))  # tells apart the fields under one key
    items = packed_items(rows)
    bad = chain_posteriors(items).where("chain <> 'sound'")

    @F.pandas_udf("string")
    def mend(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for item, chain in batches:
            yield pd.Series([repaired(i, c) for i, c in zip(item, chain)], dtype=object)

    bad = bad.select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("item").alias("i"), mend("item", "chain").alias("mended"))
    hits = items.join(bad, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("item") == F.col("i")))
    # only garbled items travel on; each record's list is no longer than the record
    lists = hits.groupBy(F.col("key").alias("k"), F.col("h").alias("g")).agg(F.max(F.col("mended").isNull()).alias("lost"), F.collect_list(F.struct("pos", "field", F.coalesce("mended", "item").alias("now"))).alias("now"))
    both = rows.join(lists, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")), "left")
    garbled = F.col("lost").isNotNull()

    def part(text: Column, pos: Column) -> Column:
        here = F.filter("now", lambda x: x["pos"] == pos)
        new = lambda field: F.get(F.filter(here, lambda x: x["field"] == field), F.lit(0))["now"]
        note = F.when(text.contains(";"), F.concat(F.lit(";"), F.coalesce(new("note"), F.substring(text, F.locate(";", text) + 1, F.length(text)))))
        return F.concat(F.coalesce(new("candidate"), F.substring_index(text, ";", 1)), F.coalesce(note, F.lit("")))

    return both.select(
        F.col("key").alias(key),
        garbled.alias("garbled"),
        F.when(garbled, ~F.col("lost")).alias("recovered"),
        F.when(garbled, F.array_join(F.transform(F.split("packed", "/", -1), part), "/")).otherwise(F.col("packed")).alias("repaired"),
    )
