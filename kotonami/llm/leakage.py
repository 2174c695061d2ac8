"""Evaluation texts leaking into training text: BM25 over test items, block-max WAND, exact check.

The terms are character n-grams of the normalised text. The index holds the test items with
their BM25 impacts in posting lists cut into blocks, each with its largest impact. Every
training text is cut into overlapping passages, so that each run of `run` characters lies in
one of them; each passage is a query and retrieves every item whose score reaches the item's
own threshold: the least score that any `run` characters of the item give. No true case can
score less, so the retrieval loses none; an exact comparison then verifies the overlap.

Items of no more than BROADCAST_GRAMS n-grams make one index that every worker holds. More
are tables: postings by n-gram, with the largest impact of each block of items. Either way the
training texts are read once. There, a scan behind a Bloom filter of fixed size keeps what can
hold a run; the n-grams that together can't reach any threshold retrieve nothing (they only
add to bounds); a block is retrieved if its bound reaches the least threshold of its items.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kotonami.operators.ordered import ranked
from kotonami.runtime import cut_lineage

#: Items of no more n-grams than this are indexed on the driver and broadcast, at about 500 bytes an n-gram.
BROADCAST_GRAMS = 300_000
#: Bits of the Bloom filter of the n-grams of larger sets of items, as a power of two (16 MB); items in a block of postings.
BLOOM_BITS, BLOCK_ITEMS = 27, 32
K1, B = 1.2, 0.75

# marks that compose with a letter stay until they are composed; selectors and joiners go
_COMPOSING = f"{chr(0x300)}-{chr(0x34E)}{chr(0x350)}-{chr(0x36F)}{chr(0x3099)}{chr(0x309A)}"
_BEFORE = re.compile(rf"(?:[^\w{_COMPOSING}]|_)+")
_AFTER = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """Letters and digits only, in one width and case: what counts in the comparison."""
    return _AFTER.sub("", unicodedata.normalize("NFKC", _BEFORE.sub("", text or "")).casefold())


def gram_hashes(text: str, gram: int) -> np.ndarray:
    """A 64-bit hash of every n-gram of the text, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(gram):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
            out ^= out >> np.uint64(29)
    return out * np.uint64(0xD6E8FEB86659FD93)


def long_stretches(at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches of at least `least` consecutive numbers in sorted `at`."""
    if len(at) < least:
        return []
    cuts = np.flatnonzero(np.diff(at) != 1)
    first, last = np.r_[0, cuts + 1], np.r_[cuts, len(at) - 1]
    keep = last - first + 1 >= least
    return [(int(at[f]), int(at[e])) for f, e in zip(first[keep], last[keep])]


class BlockMaxIndex:
    """BM25 impacts of items by n-gram, for exhaustive retrieval above thresholds."""

    def __init__(self, items: dict[int, str], gram: int = 8, run: int = 30, k1: float = K1, b: float = B, block: int = 32):
        self.gram, self.run = gram, run
        self.texts = {i: t for i, t in items.items() if len(t) >= run}
        self.names = sorted(self.texts)
        tf = [Counter(self._grams(self.texts[i])) for i in self.names]
        df = Counter(g for c in tf for g in c)
        mean = sum(map(len, self.texts.values())) / max(len(self.texts), 1)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(tf):
            norm = k1 * (1 - b + b * len(self.texts[self.names[k]]) / mean)
            for g, f in c.items():
                postings[g].append((k, log(1 + (len(tf) - df[g] + 0.5) / (df[g] + 0.5)) * f * (k1 + 1) / (f + norm)))
        self.grams = {g: t for t, g in enumerate(postings)}
        self.lists = [[k for k, _ in p] for p in postings.values()]
        self.impacts = [[s for _, s in p] for p in postings.values()]
        self.tops = [max(s) for s in self.impacts]
        self.blocks = [[(p[min(i + block, len(p)) - 1], max(s[i : i + block])) for i in range(0, len(p), block)] for p, s in zip(self.lists, self.impacts)]
        self.thresholds = [self._threshold(k, t) for k, t in enumerate(self.texts[i] for i in self.names)]
        self.least = min(self.thresholds, default=0.0)
        self.runs = [{t[i : i + run] for i in range(len(t) - run + 1)} for t in (self.texts[i] for i in self.names)]
        # for the scan: sorted hashes of the grams with their ids, behind a bit table
        hashes = np.array([self.hashes(g)[0] for g in self.grams], np.uint64) if self.grams else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order.astype(np.int64)
        self.gram_text = list(self.grams)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.top_array = np.array(self.tops)

    def _grams(self, text: str) -> list[str]:
        return [text[i : i + self.gram] for i in range(len(text) - self.gram + 1)]

    def _threshold(self, k: int, text: str) -> float:
        """The least score of any `run` characters of the item (repeated grams of a query count once)."""
        scores = [self.impacts[t][bisect_left(self.lists[t], k)] for t in (self.grams[g] for g in self._grams(text))]
        grams, width = self._grams(text), self.run - self.gram + 1
        least = min(sum({g: s for g, s in zip(grams[i : i + width], scores[i : i + width])}.values()) for i in range(len(text) - self.run + 1))
        return least * (1 - 1e-9)

    def hashes(self, text: str) -> np.ndarray:
        return gram_hashes(text, self.gram)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the text's n-grams that the index holds, and their terms."""
        h = self.hashes(text)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        same = self.sorted[place] == h[maybe]
        at, terms = maybe[same], self.ids[place[same]]
        true = [text.startswith(self.gram_text[t], p) for p, t in zip(at.tolist(), terms.tolist())]
        return at[true], terms[true]

    def retrieve(self, terms: list[int]) -> list[int]:
        """Items whose score over the distinct `terms` reaches their threshold, by block-max WAND."""
        lists = [(self.lists[t], self.impacts[t], self.blocks[t], self.tops[t]) for t in terms]
        cursor = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while live:
            live.sort(key=lambda j: lists[j][0][cursor[j]])
            bound, pivot = 0.0, -1
            for n, j in enumerate(live):
                bound += lists[j][3]
                if bound >= self.least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][cursor[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][cursor[live[pivot + 1]]] == item:
                pivot += 1
            group = live[: pivot + 1]
            close, last = 0.0, 1 << 60
            for j in group:  # bounds of the blocks that may hold the item
                blocks = lists[j][2]
                b = bisect_left(blocks, (item, -1.0))
                if b < len(blocks):
                    close, last = close + blocks[b][1], min(last, blocks[b][0])
            if close >= min(self.thresholds[item], self.least):
                score = 0.0
                for j in group:
                    items = lists[j][0]
                    c = cursor[j] = bisect_left(items, item, cursor[j])
                    if c < len(items) and items[c] == item:
                        score += lists[j][1][c]
                        cursor[j] = c + 1
                if score >= self.thresholds[item]:
                    found.append(item)
            else:  # no item up to the end of the nearest block, or before the next list begins, can do
                ahead = lists[live[pivot + 1]][0][cursor[live[pivot + 1]]] if pivot + 1 < len(live) else 1 << 60
                for j in group:
                    cursor[j] = bisect_left(lists[j][0], max(min(last + 1, ahead), item + 1), cursor[j])
            live = [j for j in live if cursor[j] < len(lists[j][0])]
        return found

    def leaked(self, text: str | None, passage: int = 256) -> list[int]:
        """Names of the items of which the text holds `run` consecutive letters and digits."""
        plain = letters(text)
        if len(plain) < self.run or not self.names:
            return []
        at, terms = self.hits(plain)
        stretches = long_stretches(at, self.run - self.gram + 1)  # a run has all its n-grams in the index
        if not stretches:
            return []
        inside = np.zeros(len(at), bool)
        for first, last in stretches:
            inside[np.searchsorted(at, first) : np.searchsorted(at, last) + 1] = True
        at, terms = at[inside], terms[inside]
        found: set[int] = set()
        step = passage - self.run + 1
        begin = 0
        while begin < len(at):
            first = int(at[begin]) // step * step  # the passage that holds this hit
            for start in {max(0, first - step), first}:
                lo, hi = np.searchsorted(at, [start, start + passage - self.gram + 1])
                own = np.unique(terms[lo:hi])
                if len(own) and self.top_array[own].sum() >= self.least:
                    for item in self.retrieve(own.tolist()):
                        if self.names[item] not in found and any(plain[p : p + self.run] in self.runs[item] for p in at[lo:hi].tolist()):
                            found.add(self.names[item])
            begin = int(np.searchsorted(at, first + step))
        return sorted(found)


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, run: int = 30, gram: int = 8) -> DataFrame:
    """Distinct (key, item_key) of texts that hold at least `run` consecutive letters and digits of a passage.

    Null texts and passages shorter than `run` give no row; several passages under one item_key all count.
    """
    rows = documents.where(documents[text].isNotNull()).select(documents[key].alias("key"), documents[text].alias("text"))
    own = items.where(items[passage].isNotNull()).select(items[item_key].alias("item"), items[passage].alias("passage"))
    kind = own.schema["item"].dataType.simpleString()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [letters(t) for t in batch.column("passage").to_pylist()]
            keep = pa.array([len(t) >= run for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("item").filter(keep), pa.array(texts, pa.string()).filter(keep)], ["item", "plain"])

    passages = cut_lineage(own.mapInArrow(plain, f"item {kind}, plain STRING").distinct())
    grams = passages.agg(F.coalesce(F.sum(F.length("plain") - (gram - 1)), F.lit(0))).first()[0]
    found = _by_broadcast(rows, passages, run, gram) if grams <= BROADCAST_GRAMS else _by_tables(rows, passages, run, gram)
    return found.distinct().select(F.col("key").alias(key), F.col("item").alias(item_key))


def _by_broadcast(rows: DataFrame, passages: DataFrame, run: int, gram: int) -> DataFrame:
    """(key, item) by one index of checked size that all workers hold."""
    own = [(r["item"], r["plain"]) for r in passages.toLocalIterator()]
    index = rows.sparkSession.sparkContext.broadcast((BlockMaxIndex(dict(enumerate(t for _, t in own)), gram, run), [i for i, _ in own]))
    kinds = [rows.schema["key"].dataType.simpleString(), passages.schema["item"].dataType.simpleString()]
    item_type = to_arrow_type(passages.schema["item"].dataType)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = index.value
        for batch in batches:
            lists = [held.leaked(t) for t in batch.column("text").to_pylist()]
            where = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.record_batch({"key": batch.column("key").take(pa.array(where)), "item": pa.array([name[i] for x in lists for i in x], item_type)})

    return rows.mapInArrow(ask, f"key {kinds[0]}, item {kinds[1]}")


def _postings(passages: DataFrame, gram: int) -> DataFrame:
    """(pid, len, h, tf) of passages (pid, plain)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, text in zip(batch.column("pid").to_pylist(), batch.column("plain").to_pylist()):
                h, tf = np.unique(gram_hashes(text, gram).view(np.int64), return_counts=True)
                yield pa.record_batch({"pid": np.full(len(h), pid, np.int32), "len": np.full(len(h), len(text), np.int32), "h": h, "tf": tf.astype(np.int32)})

    return passages.select("pid", "plain").mapInArrow(cut, "pid INT, len INT, h BIGINT, tf INT")


def _bloom(grams: DataFrame) -> np.ndarray:
    """A bit table of the hashes `h`; its words are combined before they reach the driver, 2 ** BLOOM_BITS bits at most."""
    bit = F.shiftrightunsigned("h", 64 - BLOOM_BITS)
    words = grams.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - BLOOM_BITS}) % 64 AS INT))")).alias("v"))
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    for batch in words.toLocalIterator():
        table[batch["w"]] = batch["v"]
    return table


def _by_tables(rows: DataFrame, passages: DataFrame, run: int, gram: int, width: int = 256) -> DataFrame:
    """(key, item) by postings as tables; one scan of the rows, nothing of the index on the driver but its Bloom filter."""
    spark = rows.sparkSession
    numbered = cut_lineage(ranked(passages, ["item", "plain"], "pid").withColumn("block", F.floor(F.col("pid") / BLOCK_ITEMS)))
    stats = numbered.agg(F.count("*").alias("n"), F.avg(F.length("plain")).alias("mean")).first()
    post = cut_lineage(_postings(numbered, gram))
    df = post.groupBy("h").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(stats["mean"])))
    post = cut_lineage(post.join(df, "h").select("pid", F.floor(F.col("pid") / BLOCK_ITEMS).alias("block"), "h", impact.alias("impact")))
    blocks = cut_lineage(post.groupBy("h", "block").agg(F.max("impact").alias("top")))
    grams = cut_lineage(blocks.groupBy("h").agg(F.max("top").alias("top")))

    def thresholds(batches):
        for pdf in batches:
            least = []
            for text, own in zip(pdf.plain, pdf.own):
                impacts = {x["h"]: x["impact"] for x in own}
                h = gram_hashes(text, gram).view(np.int64).tolist()
                size = run - gram + 1
                least.append(min(sum(impacts[g] for g in set(h[i : i + size])) for i in range(len(h) - size + 1)) * (1 - 1e-9))
            yield pdf[["block"]].assign(least=least)

    lists = post.groupBy("pid").agg(F.collect_list(F.struct("h", "impact")).alias("own"))  # no longer than the passage
    block_least = cut_lineage(numbered.join(lists, "pid").select("block", "plain", "own").mapInPandas(thresholds, "block BIGINT, least DOUBLE").groupBy("block").agg(F.min("least").alias("least")))
    least = block_least.agg(F.min("least")).first()[0]
    bits = spark.sparkContext.broadcast(_bloom(grams))
    shift, size = np.uint64(64 - BLOOM_BITS), run - gram + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            source, texts, hashes = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                plain = letters(text)
                h = gram_hashes(plain, gram)
                place = (h >> shift).astype(np.int64)
                at = np.flatnonzero((table[place >> 6] >> (place & 63)) & 1)
                for first, last in long_stretches(at, size):
                    for a in range(first, last + gram - run + 1, width - run + 1):
                        b = min(a + width, last + gram)
                        source.append(i)
                        texts.append(plain[a:b])
                        hashes.append(np.unique(h[a : b - gram + 1].view(np.int64)).tolist())
            yield pa.record_batch({"key": batch.column("key").take(pa.array(source, pa.int64())), "plain": pa.array(texts, pa.string()), "hs": pa.array(hashes, pa.list_(pa.int64()))})

    kind = rows.schema["key"].dataType.simpleString()
    asked = cut_lineage(rows.mapInArrow(scan, f"key {kind}, plain STRING, hs ARRAY<BIGINT>")).withColumn("id", F.monotonically_increasing_id())
    met = asked.select("id", F.explode("hs").alias("h")).join(grams, "h")
    light = F.sum("top").over(Window.partitionBy("id").orderBy("top", "h").rowsBetween(Window.unboundedPreceding, 0))  # at most `width` rows each
    split = met.withColumn("so_far", light)
    rest = split.where(F.col("so_far") < least).groupBy("id").agg(F.sum("top").alias("rest"))
    bound = split.where(F.col("so_far") >= least).select("id", "h").join(blocks, "h").groupBy("id", "block").agg(F.sum("top").alias("bound"))
    close = bound.join(rest, "id", "left").join(block_least, "block").where(F.col("bound") + F.coalesce("rest", F.lit(0.0)) >= F.col("least")).select("id", "block")
    texts = numbered.groupBy("block").agg(F.collect_list(F.struct("item", "plain")).alias("items"))  # BLOCK_ITEMS of them
    pairs = close.join(asked.select("id", "key", "plain"), "id").join(texts, "block")

    item_type = to_arrow_type(passages.schema["item"].dataType)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def runs(text: str) -> frozenset[str]:
            return frozenset(text[i : i + run] for i in range(len(text) - run + 1))

        for batch in batches:
            source, found = [], []
            for n, (text, own) in enumerate(zip(batch.column("plain").to_pylist(), batch.column("items").to_pylist())):
                mine = [text[i : i + run] for i in range(len(text) - run + 1)]
                hit = [x["item"] for x in own if not runs(x["plain"]).isdisjoint(mine)]
                source += [n] * len(hit)
                found += hit
            yield pa.record_batch({"key": batch.column("key").take(pa.array(source, pa.int64())), "item": pa.array(found, item_type)})

    item_kind = passages.schema["item"].dataType.simpleString()
    return pairs.select("block", "key", "plain", "items").sortWithinPartitions("block").mapInArrow(verify, f"key {kind}, item {item_kind}")
