"""Items that appear together: exact pair counts against a fitted configuration null.

Counting. Items that can't be part of any reported pair are dropped first, exactly: a pair
needs `least` common records, and n_ab * N >= lift * n_a * n_b with n_ab <= n_a, n_b bounds
either item by N / lift. Records of at most `crowd` kept items give their pairs directly,
combined map-side. Larger ones are numbered, and 512 of them make a chunk: an item's records
in a chunk are eight 64-bit words, whatever their number. A pair that some ordinary record
has gets its share of the crowded ones by the words of its two items, chunk by chunk, where
that could still make it a case. Pairs that only crowded records have are found by products
of bit matrices, in cells of a chunk and two blocks of about BLOCK items: a cell's size is
bounded, and it gives only pairs that its count and the items' records elsewhere don't rule out.

Null. For baskets, the bipartite configuration model gives item a and record r the link
probability x_a y_r / (1 + x_a y_r), fitted to item frequencies and record sizes; for records
that name their pairs themselves, a pair has x_a x_b y_r / (1 + x_a x_b y_r) in record r, fitted to
the items' numbers of pairs and the records' numbers of pairs, so observed and expected count the same thing.
Items of one degree share x and records of one size share y, so the fit works on the table of
degrees, in logarithmic classes 1.1 % wide from EXACT_DEGREES on, a bounded size whatever the
data; x of an item is then solved for its own degree. The number of records with the pair is
Poisson-binomial; its upper tail is a saddlepoint (Lugannani-Rice) value, and
Benjamini-Hochberg over all item pairs bounds false discovery.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.operators.ordered import ranked
from kotonami.runtime import cut_lineage

#: Degrees from here on share logarithmic classes in the fit (64 a doubling, so at most 64 * 53 of them).
EXACT_DEGREES = 1024
#: Words of 64 records in a chunk of crowded records; items in a block of a cell, about.
WORDS, BLOCK = 8, 2048
#: A vocabulary of no more items is broadcast to its records; about 100 bytes an item.
BROADCAST_ITEMS = 200_000
#: Pairs with a q-value up to this are marked as surprising.
FALSE_DISCOVERY = 0.05
#: Bins of -log10(p) for the false-discovery control: a tenth each, up to 320.
P_BINS = 3201


def degree_class(n) -> np.ndarray:
    """Exact below EXACT_DEGREES; 64 classes a doubling above."""
    n = np.asarray(n, float)
    return np.where(n < EXACT_DEGREES, n, np.floor(2 ** (np.floor(np.log2(np.maximum(n, 1)) * 64) / 64)))


def fit_configuration(item_degree: np.ndarray, item_count: np.ndarray, rec_degree: np.ndarray, rec_count: np.ndarray, rounds: int = 400, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Fugacities x of item classes and y of record classes, by fixed-point iteration in turns."""
    total = max((item_degree * item_count).sum(), 1.0)
    x, y = item_degree / np.sqrt(total), rec_degree / np.sqrt(total)
    for _ in range(rounds):
        old = x
        x = item_degree / np.maximum(((rec_count * y) / (1 + np.outer(x, y))).sum(1), 1e-300)
        y = rec_degree / np.maximum(((item_count * x)[:, None] / (1 + np.outer(x, y))).sum(0), 1e-300)
        scale = max((rec_count * y).sum(), 1e-300)  # only x y counts, so one factor is free
        x, y = x * scale, y / scale
        if np.max(np.abs(x - old) / np.maximum(old, 1e-300), initial=0) < tol:
            break
    return x, y


def upper_tail(k: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, log10 P(X >= k)) of sums of binomials: q[i, j] probability of pair i in each of m[j] records.

    Lugannani-Rice with the first continuity correction; k at or below the mean gives the normal value.
    """
    q = np.clip(q, 1e-15, 1 - 1e-12)
    mean, var = q @ m, (q * (1 - q)) @ m
    top = m.sum()
    kk = np.minimum(k, top - 1e-6)
    t = np.log(np.maximum(kk, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(60):  # Newton, on K'(t) = k
        e = q * np.exp(np.clip(t, -600, 600))[:, None]
        p = e / (1 - q + e)
        step = (p @ m - kk) / np.maximum((p * (1 - p)) @ m, 1e-300)
        t = t - np.clip(step, -2, 2)
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    e = q * np.exp(t)[:, None]
    p = e / (1 - q + e)
    big_k = np.log1p(q * np.expm1(t)[:, None]) @ m
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * kk - big_k), 0))
    u = -np.expm1(-t) * np.sqrt(np.maximum((p * (1 - p)) @ m, 1e-300))
    near = (np.abs(t) < 1e-3) | (kk <= mean)
    wn, un = np.where(near, 1.0, w), np.where(near, 1.0, u)
    log_phi = -wn * wn / 2 - 0.5 * np.log(2 * np.pi)
    # Mills ratio by continued fraction for large w keeps the difference of small numbers exact enough
    mills = np.where(wn > 5, 1 / (wn + 1 / (wn + 2 / (wn + 3 / (wn + 4 / (wn + 5 / wn))))), 0.0)
    small = wn <= 5
    mills[small] = _normal_tail(wn[small]) / np.exp(log_phi[small])
    tail = log_phi + np.log(np.maximum(mills + 1 / un - 1 / wn, 1e-300))
    z = (k - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300))
    normal = np.log(np.maximum(_normal_tail(np.clip(z, -30, 30)), 1e-300))
    return mean, np.minimum(np.where(near, normal, tail), 0.0) / np.log(10)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([erfc(v / np.sqrt(2)) / 2 for v in z])


def _pairs_of(members: DataFrame) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b) of members (rec, item, n_item), each record's pairs listed from its sorted items."""
    baskets = members.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("item", "n_item"))).alias("b")).where(F.size("b") > 1)
    firsts = baskets.select(F.posexplode("b").alias("p", "a"), "b")
    pairs = firsts.select("a", F.explode(F.expr("slice(b, p + 2, size(b))")).alias("c"))
    return pairs.groupBy(F.col("a.item").alias("item_a"), F.col("c.item").alias("item_b")).agg(F.count("*").alias("n_ab"), F.first("a.n_item").alias("n_a"), F.first("c.n_item").alias("n_b"))


def _chunk_words(crowded: DataFrame) -> DataFrame:
    """(item, n_item, chunk, d, w0 ...): an item's crowded records in a chunk as bits, and their number d."""
    numbered = ranked(crowded.select("rec").distinct(), ["rec"], "no").select("rec", "no")
    bit = lambda j: F.when(F.floor(F.col("no") / 64) % WORDS == j, F.expr("shiftleft(1L, no % 64)")).otherwise(F.lit(0).cast("bigint"))
    words = [F.bit_or(bit(j)).alias(f"w{j}") for j in range(WORDS)]
    return crowded.join(numbered, "rec").groupBy("item", F.floor(F.col("no") / (64 * WORDS)).alias("chunk")).agg(F.first("n_item").alias("n_item"), F.count("*").alias("d"), *words)


def _needed(n_a, n_b, total, least: int, lift: int):
    """The least count that makes a pair a case; of columns or arrays."""
    return F.greatest(F.lit(least), F.ceil(lift * n_a * n_b / total))


def _with_crowded(counts: DataFrame, crowded: DataFrame, total: DataFrame, least: int, lift: int) -> DataFrame:
    """Add what the crowded records hold to the counts of ordinary ones; exact for every pair that can be a case."""
    words = cut_lineage(_chunk_words(crowded))
    n_records = total.first()[0]
    own = cut_lineage(words.groupBy("item").agg(F.sum("d").alias("cd")))
    # pairs that ordinary records have too
    degree = lambda side: own.select(F.col("item").alias(f"item_{side}"), F.col("cd").alias(f"cd_{side}"))
    both = counts.join(degree("a"), "item_a", "left").join(degree("b"), "item_b", "left").withColumn("most", F.coalesce(F.least("cd_a", "cd_b"), F.lit(0)))
    both = both.withColumn("most", F.when(F.col("cd_a").isNull() | F.col("cd_b").isNull(), 0).otherwise(F.col("most")))
    open_ = F.col("n_ab") + F.col("most") >= _needed(F.col("n_a"), F.col("n_b"), F.lit(float(n_records)), least, lift)
    both = cut_lineage(both.where(open_).select("item_a", "item_b", "n_ab", "n_a", "n_b", "most"))
    side = lambda k: words.select(F.col("item").alias(f"item_{k}"), "chunk", *[F.col(f"w{j}").alias(f"{k}{j}") for j in range(WORDS)])
    common = sum((F.bit_count(F.col(f"a{j}").bitwiseAND(F.col(f"b{j}"))) for j in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseAND(F.col("b0"))))
    met = both.where("most > 0").select("item_a", "item_b").join(side("a"), "item_a").join(side("b"), ["item_b", "chunk"])
    shares = met.groupBy("item_a", "item_b").agg(F.sum(common).alias("more"))
    old = both.join(shares, ["item_a", "item_b"], "left").select("item_a", "item_b", (F.col("n_ab") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_ab"), "n_a", "n_b")
    # pairs that only crowded records have: both items in at least `least` of them
    often = own.where(F.col("cd") >= least)
    n_blocks = max(1, -(-often.count() // BLOCK))
    rows = words.join(often, "item").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        bits = np.unpackbits(np.ascontiguousarray(pdf[[f"w{j}" for j in range(WORDS)]].to_numpy(np.int64)).view(np.uint8), axis=1).astype(np.float32)
        x, y = pdf.x.iat[0], pdf.y.iat[0]
        left, right = np.flatnonzero(pdf.block == x), np.flatnonzero(pdf.block == y)
        common = (bits[left] @ bits[right].T).astype(np.int64)
        n, d, cd = (pdf[c].to_numpy(np.int64) for c in ("n_item", "d", "cd"))
        rest = np.minimum((cd - d)[left][:, None], (cd - d)[right][None, :])
        need = np.maximum(least, np.ceil(lift * n[left][:, None].astype(float) * n[right][None, :] / n_records))
        keep = (common > 0) & (common + rest >= need)
        i, j = np.nonzero(np.triu(keep, 1) if x == y else keep)
        items = pdf.item.to_numpy(object)
        a, b = left[i], right[j]
        a, b = np.minimum(a, b), np.maximum(a, b)  # rows are in order of items
        return pd.DataFrame({"item_a": items[a], "item_b": items[b], "part": common[i, j], "n_a": n[a], "n_b": n[b]})

    parts = rows.groupBy("chunk", "x", "y").applyInPandas(cell, "item_a STRING, item_b STRING, part BIGINT, n_a BIGINT, n_b BIGINT")
    new = parts.groupBy("item_a", "item_b").agg(F.sum("part").alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).where(F.col("n_ab") >= least)
    new = new.join(counts.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
    return old.unionByName(new)


def basket_pairs(items: DataFrame, total: DataFrame, least: int = 5, lift: int = 4, crowd: int = 400) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, total) of the pairs that reach `least` and `lift`.

    `items`: distinct (rec, item), read several times, so best a written table; `total`: one row
    (total), all records counted, also those without items. Null items or records are not to be among them.
    """
    n = items.groupBy("item").agg(F.count("*").alias("n_item"))
    kept = n.where(F.col("n_item") >= least).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").where(F.col("n_item") * lift <= F.col("total")).select("item", "n_item")
    kept = cut_lineage(kept)
    members = items.join(F.broadcast(kept) if kept.count() <= BROADCAST_ITEMS else kept, "item")
    sizes = members.groupBy("rec").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("rec")
    sizes = cut_lineage(sizes)
    if sizes.isEmpty():
        return _enough(_pairs_of(members), total, least, lift)
    members = cut_lineage(members)
    counts = cut_lineage(_pairs_of(members.join(sizes, "rec", "left_anti")))
    return _enough(_with_crowded(counts, members.join(sizes, "rec", "left_semi"), total, least, lift), total, least, lift)


def keyed_pairs(links: DataFrame, items: DataFrame, total: DataFrame, least: int = 5, lift: int = 4) -> DataFrame:
    """As basket_pairs, where each record names its pairs itself: links(rec, item_a, item_b), distinct, item_a < item_b."""
    n = items.groupBy("item").agg(F.count("*").alias("n_item"))
    counts = links.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    counts = counts.join(n.toDF("item_a", "n_a"), "item_a").join(n.toDF("item_b", "n_b"), "item_b")
    return _enough(counts, total, least, lift)


def _enough(counts: DataFrame, total: DataFrame, least: int, lift: int) -> DataFrame:
    wide = counts.where(F.col("n_ab") >= least).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    return wide.where(F.col("n_ab") * F.col("total") >= lift * F.col("n_a") * F.col("n_b")).select("item_a", "item_b", "n_ab", "n_a", "n_b", "total")


def _degrees(counted: DataFrame) -> pd.DataFrame:
    """Number of items (records) by class of degree; at most EXACT_DEGREES + 64 * 53 rows reach the driver."""
    d = F.col("d")
    klass = F.when(d < EXACT_DEGREES, d.cast("double")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(d) * 64) / 64)).cast("double"))
    return counted.groupBy(klass.alias("k")).agg(F.count("*").alias("n"), F.avg("d").alias("d")).orderBy("k").toPandas()


def fugacity(degree: np.ndarray, start: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x of items of these degrees, given the records' y: the root of degree = sum m x y / (1 + x y), by Newton on log x."""
    x = np.log(np.maximum(start, 1e-300))
    degree = np.minimum(degree, m.sum() * (1 - 1e-12))
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x[:, None] + np.log(y), -600, 600)))
        step = (p @ m - degree) / np.maximum((p * (1 - p)) @ m, 1e-300)
        x = x - np.clip(step, -2, 2)
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    return np.exp(x)


def _grid(z: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and weight of the upper border of each log z on an even grid."""
    at = np.clip((z - grid[0]) / (grid[1] - grid[0]), 0, len(grid) - 1 - 1e-9)
    low = at.astype(int)
    return low, at - low


def fit_links(item_degree: np.ndarray, item_count: np.ndarray, rec_links: np.ndarray, rec_count: np.ndarray, rounds: int = 400, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """x of item classes and y of record classes, where a record has the pair (a, b) with odds x_a x_b y_r.

    Items have `item_degree` pairs over all records, records `rec_links` pairs. Sums over
    records depend on z = x_a x_b alone and are interpolated on a fine grid of log z.
    """
    links = max((rec_links * rec_count).sum(), 1.0)
    x, y = item_degree / np.sqrt(2 * links), rec_links / links
    if not len(x):
        return x, y
    other = item_count[None, :] - np.eye(len(item_count))  # an item doesn't pair with itself
    for _ in range(rounds):
        old = x
        z = np.log(np.maximum(np.outer(x, x), 1e-300))
        grid = np.linspace(z.min() - 1, z.max() + 1, 2000)
        low, up = _grid(z, grid)
        sums = (1 / (1 + np.exp(grid)[:, None] * y)) @ (rec_count * y)
        x = np.sqrt(x * item_degree / np.maximum((other * x[None, :] * (sums[low] * (1 - up) + sums[low + 1] * up)).sum(1), 1e-300))
        z = np.log(np.maximum(np.outer(x, x), 1e-300))
        grid = np.linspace(z.min() - 1, z.max() + 1, 2000)
        low, up = _grid(z, grid)
        pairs = (item_count[:, None] * other / 2).ravel()
        weight = np.bincount(low.ravel(), pairs * (1 - up.ravel()), len(grid)) + np.bincount(low.ravel() + 1, pairs * up.ravel(), len(grid))
        zs = np.exp(grid)
        y = rec_links / np.maximum((weight * zs / (1 + zs * y[:, None])).sum(1), 1e-300)
        scale = max((rec_count * y).sum(), 1e-300)  # only x_a x_b y_r counts, so one factor is free
        x, y = x * np.sqrt(scale), y / scale
        if np.max(np.abs(x - old) / np.maximum(old, 1e-300), initial=0) < tol:
            break
    return x, y


def surprise(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """`pairs` of baskets with `expected` count and `log10_p` under the fitted null, `q_value` over all item pairs, and `surprising`."""
    by_item = _degrees(items.groupBy("item").agg(F.count("*").alias("d")))
    by_rec = _degrees(items.groupBy("rec").agg(F.count("*").alias("d")))
    x, y = fit_configuration(by_item.d.to_numpy(float), by_item.n.to_numpy(float), by_rec.d.to_numpy(float), by_rec.n.to_numpy(float))
    m = by_rec.n.to_numpy(float)

    def probability(start_a, start_b, da, db):
        xa, xb = (fugacity(d, s, y, m)[:, None] * y for d, s in ((da, start_a), (db, start_b)))
        return (xa / (1 + xa)) * (xb / (1 + xb))

    return _scored(pairs, "n_a", "n_b", by_item, x, m, probability)


def link_surprise(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """As `surprise`, where records name their pairs: links(rec, item_a, item_b), distinct. The null keeps the items' and records' numbers of links."""
    ends = links.select("rec", F.explode(F.array("item_a", "item_b")).alias("item"))
    degree = cut_lineage(ends.groupBy("item").agg(F.count("*").alias("d")))
    by_item, by_rec = _degrees(degree), _degrees(links.groupBy("rec").agg(F.count("*").alias("d")))
    x, y = fit_links(by_item.d.to_numpy(float), by_item.n.to_numpy(float), by_rec.d.to_numpy(float), by_rec.n.to_numpy(float))

    def probability(xa, xb, da, db):
        # degrees within a class differ by 1.1 % at most; x is nearly proportional to the degree there
        z = (xa * xb)[:, None] * y
        return z / (1 + z)

    wide = pairs.join(degree.toDF("item_a", "k_a"), "item_a").join(degree.toDF("item_b", "k_b"), "item_b")
    return _scored(wide, "k_a", "k_b", by_item, x, by_rec.n.to_numpy(float), probability).drop("k_a", "k_b")


def _scored(pairs: DataFrame, deg_a: str, deg_b: str, by_item: pd.DataFrame, x: np.ndarray, m: np.ndarray, probability) -> DataFrame:
    """`pairs` with expected, log10_p, q_value and surprising; probability(x_a, x_b, degree_a, degree_b) gives a row for each pair, a column for each record class."""
    spark = pairs.sparkSession
    model = spark.sparkContext.broadcast((by_item.k.to_numpy(), by_item.d.to_numpy(float), x, m))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", expected DOUBLE, log10_p DOUBLE"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, mean_degree, xs, counts = model.value
        for pdf in batches:
            if not len(pdf):
                continue
            # tails depend on the degrees and the count only: pairs alike share one computation
            key = np.column_stack([np.minimum(pdf[deg_a], pdf[deg_b]), np.maximum(pdf[deg_a], pdf[deg_b]), pdf.n_ab]).astype(float)
            uniq, inverse = np.unique(key, axis=0, return_inverse=True)
            mean, logp = np.empty(len(uniq)), np.empty(len(uniq))
            for s in range(0, len(uniq), 2048):
                part = uniq[s : s + 2048]
                ends = []
                for d in (part[:, 0], part[:, 1]):
                    at = np.clip(np.searchsorted(classes, degree_class(d)), 0, len(xs) - 1)
                    ends.append(xs[at] * d / mean_degree[at])
                mean[s : s + 2048], logp[s : s + 2048] = upper_tail(part[:, 2], probability(*ends, part[:, 0], part[:, 1]), counts)
            inverse = inverse.reshape(-1)
            yield pdf.assign(expected=mean[inverse], log10_p=logp[inverse])

    scored = cut_lineage(pairs.mapInPandas(score, schema))
    n_items = float(by_item.n.sum())
    tests = max(n_items * (n_items - 1) / 2, 1.0)
    bin_of = F.least(F.floor(-F.col("log10_p") * 10), F.lit(P_BINS - 1)).cast("int")
    bins = scored.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).toPandas().sort_values("bin", ascending=False)
    rank = bins.n.cumsum().to_numpy(float)  # every pair of the bin ranks at most so: its lower edge gives an upper bound of q
    q = np.minimum(10 ** (-bins.bin.to_numpy(float) / 10) * tests / np.maximum(rank, 1), 1.0)
    q = np.minimum.accumulate(q[::-1])[::-1] if len(q) else q
    table = spark.createDataFrame([(int(b), float(v)) for b, v in zip(bins.bin, q)], "bin INT, q_value DOUBLE")
    return scored.withColumn("bin", bin_of).join(F.broadcast(table), "bin").drop("bin").withColumn("surprising", F.col("q_value") <= FALSE_DISCOVERY)
