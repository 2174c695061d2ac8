"""Usage statistics of users, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kotonami.operators.costs import totals, with_costs
from kotonami.operators.ordered import with_previous
from kotonami.runtime import Folder

COMMIT_SCHEMA = "commit_id BIGINT, i INT, surface STRING, yomi STRING, compound_word BOOLEAN"


#: What tells two rows of users' statistics apart: exact copies count once, in batch and as a stream.
GAIN = ["user_id", "save_id", "word_key", "cnt", "saved_at", "arrived_at"]


def summed_gains(saved: DataFrame) -> DataFrame:
    """(word_key, cnt) of the gains that users' files had at each save, exact copies once.

    A stream of users: the hot user's rows only meet as sums of a key.
    """
    rows = saved.where("word_key is not null").select(*GAIN).distinct()
    return rows.groupBy("word_key").agg(F.sum("cnt").alias("cnt"))


def user_costs(counts: DataFrame) -> DataFrame:
    """Counts with their smoothed costs."""
    return with_costs(counts, totals(counts))


def unigram_counts(commits: DataFrame) -> DataFrame:
    """(key, cnt) of committed candidates."""
    return commits.groupBy(F.concat_ws("/", "surface", "yomi").alias("key")).agg(F.count("*").alias("cnt"))


def bigram_counts(commits: DataFrame) -> DataFrame:
    """(key, cnt) of neighbours within a commit."""
    keyed = commits.select("commit_id", "i", F.concat_ws("/", "surface", "yomi").alias("word"))
    pairs = with_previous(keyed, "commit_id", "i", ["word"]).where("prev is not null")
    return pairs.groupBy(F.concat_ws("\t", "prev.word", "word").alias("key")).agg(F.count("*").alias("cnt"))


def compound_entries(commits: DataFrame) -> DataFrame:
    """(yomi, surfaces) of compound words that users committed, each once."""
    return commits.where("compound_word").groupBy("yomi").agg(F.sort_array(F.collect_set("surface")).alias("surfaces"))


def user_keys(unigram: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Readings that the user's statistics and dictionary know."""
    return unigram.where(F.col("key").contains("/")).select(F.split("key", "/", 2)[1].alias("yomi")).union(dictionary.select("yomi")).distinct()


def judged_stats(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, cnt, reason) of lines 'key count', cut at the first blank; lines without a blank are none, one without a whole number has the reason 'bad count'."""
    rows = lines.where(F.col(line).contains(" ")).select(F.substring_index(line, " ", 1).alias("key"), F.expr(f"try_cast(substring({line}, locate(' ', {line}) + 1) as bigint)").alias("cnt"))
    return rows.withColumn("reason", F.when(F.col("cnt").isNull(), "bad count"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(key, cnt) of a statistics file; a bad count makes the whole file count for nothing."""
    rows = judged_stats(spark.read.text(path))
    bad = rows.where("reason is not null").limit(1).select(F.lit(True).alias("bad"))
    return rows.select("key", "cnt").join(F.broadcast(bad), F.lit(True), "left_anti")


class UserStore:
    """Three tables of one user base under a folder of any file system.

    A batch of commits is appended as a version of its own, which holds only what it adds; a
    version counts once its mark is written. After COMPACT versions these are merged to one.
    Readers see the sums of the last merged version and all later ones.
    """

    COMPACT = 20
    SCHEMAS = {"unigram": "key STRING, cnt BIGINT", "bigram": "key STRING, cnt BIGINT", "dictionary": "yomi STRING, surfaces ARRAY<STRING>"}

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _versions(self, spark: SparkSession) -> tuple[str | None, list[str]]:
        """The last merged version, and the later ones, oldest first."""
        marks = [n.removesuffix(".done") for n in Folder(spark, self.path).names() if n.endswith(".done")]
        merged = max((m for m in marks if m[0] == "m"), default=None)
        return merged, sorted(v for v in marks if v[0] == "v" and (merged is None or v[1:] > merged[1:]))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        merged, later = self._versions(spark)
        at = [f"{self.path}/{v}/{name}" for v in ([merged] if merged else []) + later]
        if not at:
            return spark.createDataFrame([], self.SCHEMAS[name])
        rows = spark.read.schema(self.SCHEMAS[name]).parquet(*at)
        if name != "dictionary":
            return rows.groupBy("key").agg(F.sum("cnt").alias("cnt"))
        return rows.select("yomi", F.explode("surfaces").alias("s")).groupBy("yomi").agg(F.sort_array(F.collect_set("s")).alias("surfaces"))

    def record(self, commits: DataFrame, version: int) -> None:
        """Add a batch of commits; a version that is already there or older is not added again."""
        spark = commits.sparkSession
        merged, later = self._versions(spark)
        newest = max([int(v[1:]) for v in ([merged] if merged else []) + later], default=-1)
        if newest >= version or commits.isEmpty():
            return
        for name, gain in (("unigram", unigram_counts(commits)), ("bigram", bigram_counts(commits)), ("dictionary", compound_entries(commits))):
            gain.write.mode("overwrite").parquet(f"{self.path}/v{version:012d}/{name}")
        Folder(spark, self.path).write(f"v{version:012d}.done", "")
        if len(later) + 1 >= self.COMPACT:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Merge all versions into one; the versions of the merge before last go, which no reader that began since then uses."""
        merged, later = self._versions(spark)
        if not later:
            return
        to, folder = f"m{later[-1][1:]}", Folder(spark, self.path)
        for name in self.SCHEMAS:
            self.read(spark, name).write.mode("overwrite").parquet(f"{self.path}/{to}/{name}")
        folder.write(f"{to}.done", "")
        if merged:
            for name in folder.names():
                if name.removesuffix(".done")[1:] < merged[1:] or name.removesuffix(".done") == f"v{merged[1:]}":
                    folder.delete(name)


def learn_stream(commits: DataFrame, store: UserStore, checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """Record a stream of commits into `store`; without `every` all that is there now, then end."""
    writer = commits.writeStream.foreachBatch(lambda batch, epoch: store.record(batch, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_counts(source: DataFrame, delay: str = "30 days", at: str = "saved_at") -> DataFrame:
    """(word_key, cnt): running sums of the gains of a stream, exact copies once; rows later than `delay` behind the newest are left out.

    For update mode: each batch gives the keys that it changes.
    """
    clean = source.where("word_key is not null").withWatermark(at, delay)
    return clean.dropDuplicatesWithinWatermark(GAIN).groupBy("word_key").agg(F.sum("cnt").alias("cnt"))


def stream_into_table(counts: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Append the changed keys of each batch, with its number, under `path`; a batch that is written again replaces itself."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word_key, cnt) after the last batch that changed each key."""
    rows = spark.read.schema("word_key STRING, cnt BIGINT, epoch BIGINT").parquet(f"{path}/changes")
    return rows.groupBy("word_key").agg(F.max_by("cnt", "epoch").alias("cnt"))


def staged(rows: DataFrame, order: str, parts: int, path: str) -> None:
    """Rows as `parts` files of about one size in order of `order`, one after the other, as a stream of files would bring them."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros(order), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    value = F.unix_micros(order)
    for low, high in zip(bounds, bounds[1:]):
        part = rows.where((F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value <= high))
        part.coalesce(1).write.mode("append").parquet(path)
