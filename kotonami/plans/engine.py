"""The conversion engine: models and dictionaries as tables, `convert` as a plan over readings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.operators import decode, evaluate, lattice
from kotonami.operators.costs import totals, with_costs
from kotonami.runtime import cut_lineage

#: Costs are compared to so many digits, so that ties don't hang on the last bits of logarithms.
COST_DIGITS = 6


@dataclass
class Engine:
    """`unigram` (word, word_id, cnt) and `bigram` (id1, id2, cnt) are count models; `dictionary` is (yomi, surfaces).

    Optional: `user` and `single` dictionaries, the user's counts `user_unigram` and
    `user_bigram` (key, cnt). A dictionary for single terms serves only readings that are one
    segment. Totals default to those of the counts.
    """

    unigram: DataFrame
    bigram: DataFrame
    dictionary: DataFrame
    user: DataFrame | None = None
    single: DataFrame | None = None
    user_unigram: DataFrame | None = None
    user_bigram: DataFrame | None = None
    unigram_stats: DataFrame | None = None
    bigram_stats: DataFrame | None = None
    keys: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.unigram_stats = self.unigram_stats or totals(self.unigram)
        self.bigram_stats = self.bigram_stats or totals(self.bigram)
        parts = [d.select("yomi") for d in (self.dictionary, self.single, self.user) if d is not None]
        self.keys = parts[0]
        for p in parts[1:]:
            self.keys = self.keys.union(p)
        self.keys = self.keys.distinct()

    def lattice(self, readings: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """Costed nodes, edges and the default edge cost of readings (sent_id, yomi, optional force_ranges)."""
        node = lattice.nodes(lattice.segments(readings, self.keys), self.dictionary, self.user, self.single)
        node = lattice.with_unigram(node, with_costs(self.unigram, self.unigram_stats))
        stats = self.unigram_stats.first()
        if self.user_unigram is not None:
            own = with_costs(self.user_unigram, totals(self.user_unigram)).select(F.col("key").alias("_k"), F.col("cost").alias("user_cost"))
            node = node.join(own, F.concat_ws("/", "surface", "yomi") == F.col("_k"), "left").drop("_k")
        else:
            node = node.withColumn("user_cost", F.lit(None).cast("double"))
        cost = lattice.node_cost(F.col("surface"), F.col("yomi"), F.col("score"), F.col("user_cost"), F.lit(stats["total_words"]), F.lit(stats["unique_words"]))
        costed = cut_lineage(node.withColumn("node_cost", F.round(cost, COST_DIGITS)))
        default = round(self.bigram_stats.first()["default_edge_cost"], COST_DIGITS)
        own_pairs = with_costs(self.user_bigram, totals(self.user_bigram)) if self.user_bigram is not None else None
        edge = lattice.known_edges(costed, with_costs(self.bigram, self.bigram_stats), own_pairs)
        return costed, edge.withColumn("edge_cost", F.round("edge_cost", COST_DIGITS)), default

    def convert(self, readings: DataFrame) -> DataFrame:
        """Ranked candidates of each clause."""
        return decode.decode(*self.lattice(readings))

    def check(self, yomi: str) -> str:
        """The conversion of one reading, clauses joined by slashes."""
        spark = self.dictionary.sparkSession
        rows = self.convert(spark.createDataFrame([(0, yomi)], "sent_id BIGINT, yomi STRING")).where("rank = 1").orderBy("clause_i").collect()
        return "/".join(r["surface"] for r in rows)

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """good, bad and recall over pairs (sent_id, yomi, surface)."""
        got = decode.best_text(self.convert(pairs.select("sent_id", "yomi"))).withColumnRenamed("surface", "got")
        return evaluate.scores(pairs.join(got, "sent_id", "left"))
