"""A plain tokenizer: the longest known word at each position, else one character.

It stands in where no morphological analyser is at hand; `register` names another, a function
of texts (sent_id, text) and words (surface, yomi) to tokens (sent_id, i, surface, yomi).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.operators.dictionary import prefix_hits

TOKENIZERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register(name: str, tokenizer: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    TOKENIZERS[name] = tokenizer


def longest_match(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(sent_id, i, surface, yomi) of texts; unknown characters are their own reading. Null and empty texts give nothing.

    Words meet the texts' substrings in an equi-join; of several readings the first in order holds.
    """
    known = words.where("surface <> ''").groupBy("surface").agg(F.min("yomi").alias("reading"))
    rows = texts.select("sent_id", F.col("text").alias("reading")).where("reading <> ''")
    hits = prefix_hits(rows, known.select(F.col("surface").alias("yomi"))).select("sent_id", "start_pos", "key")
    best = hits.groupBy("sent_id", "start_pos").agg(F.max_by("key", F.length("key")).alias("surface")).join(known, "surface")
    lists = best.groupBy("sent_id").agg(F.collect_list(F.struct("start_pos", "surface", F.col("reading").alias("yomi"))).alias("hits"))
    both = rows.join(lists, "sent_id", "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, text, hits in zip(pdf.sent_id, pdf.reading, pdf.hits):
                at, i = 0, 0
                found = {h["start_pos"]: (h["surface"], h["yomi"]) for h in hits} if hits is not None else {}
                while at < len(text):
                    surface, yomi = found.get(at, (text[at], text[at]))
                    out.append((sid, i, surface, yomi))
                    at, i = at + len(surface), i + 1
            yield pd.DataFrame(out, columns=["sent_id", "i", "surface", "yomi"])

    kind = texts.schema["sent_id"].dataType.simpleString()
    return both.mapInPandas(walk, f"sent_id {kind}, i INT, surface STRING, yomi STRING")


register("longest_match", longest_match)
