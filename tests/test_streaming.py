import datetime

from conftest import rows

from kotonami.streaming import userdata

BATCHES = [[(1, 0, "私", "わたし", False), (1, 1, "の", "の", False)], [(2, 0, "私", "わたし", False), (2, 1, "来たかな", "きたかな", True)]]


def test_stream_into_store(spark, tmp_path):
    store = userdata.UserStore(str(tmp_path / "store"))
    for n, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, userdata.COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(userdata.COMMIT_SCHEMA).parquet(str(tmp_path / "in"))
        userdata.learn_stream(stream, store, str(tmp_path / "cp"), every=None).awaitTermination()
    assert rows(store.read(spark, "unigram")) == [("の/の", 1), ("来たかな/きたかな", 1), ("私/わたし", 2)]
    assert rows(store.read(spark, "bigram")) == [("私/わたし\tの/の", 1), ("私/わたし\t来たかな/きたかな", 1)]
    assert rows(store.read(spark, "dictionary")) == [("きたかな", ["来たかな"])]
    assert rows(userdata.user_keys(store.read(spark, "unigram"), store.read(spark, "dictionary"))) == [("きたかな",), ("の",), ("わたし",)]
    store.record(spark.createDataFrame(BATCHES[0], userdata.COMMIT_SCHEMA), 0)  # an old version changes nothing
    assert rows(store.read(spark, "unigram"))[2] == ("私/わたし", 2)


def test_versions_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(userdata.UserStore, "COMPACT", 3)
    store = userdata.UserStore(str(tmp_path / "store"))
    for n in range(8):
        store.record(spark.createDataFrame(BATCHES[n % 2], userdata.COMMIT_SCHEMA), n)
    assert rows(store.read(spark, "unigram")) == [("の/の", 4), ("来たかな/きたかな", 4), ("私/わたし", 8)]
    assert rows(store.read(spark, "dictionary")) == [("きたかな", ["来たかな"])]
    kept = sorted(x.name for x in (tmp_path / "store").iterdir() if not x.name.startswith("."))
    assert [k for k in kept if k.endswith(".done")] == ["m000000000002.done", "m000000000005.done", "v000000000003.done", "v000000000004.done", "v000000000005.done", "v000000000006.done", "v000000000007.done"]


def test_stats_files(spark, tmp_path):
    (tmp_path / "s").write_text("渡し/わたし 3\nnone\n", encoding="utf-8")
    assert rows(userdata.read_stats(spark, str(tmp_path / "s"))) == [("渡し/わたし", 3)]
    (tmp_path / "bad").write_text("渡し/わたし 3\nnone\nx y\n", encoding="utf-8")
    assert rows(userdata.read_stats(spark, str(tmp_path / "bad"))) == []
    assert rows(userdata.judged_stats(spark.read.text(str(tmp_path / "bad")))) == [("x", None, "bad count"), ("渡し/わたし", 3, None)]


def test_batches_with_copies_and_late_rows(spark, tmp_path):
    day = lambda d: datetime.datetime(2023, 1, 1) + datetime.timedelta(days=d)
    batches = [
        [(1, 1, "a/a", 2, day(0), day(0)), (1, 1, "a/a", 2, day(0), day(0)), (2, 5, None, 9, day(0), day(0))],
        [(1, 2, "a/a", 3, day(5), day(5)), (1, 1, "a/a", 2, day(0), day(0))],
        [(3, 1, "b/b", 1, day(1), day(6))],
        [(1, 3, "b/b", 4, day(60), day(60))],
        [(9, 1, "c/c", 1, day(58), day(61))],
        [(9, 2, "a/a", 100, day(3), day(62))],  # later than the delay behind the newest row: left out
    ]
    schema = "user_id BIGINT, save_id BIGINT, word_key STRING, cnt BIGINT, saved_at TIMESTAMP, arrived_at TIMESTAMP"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = userdata.stream_into_table(userdata.stream_counts(stream), str(tmp_path / "out"))
    query.awaitTermination()
    assert rows(userdata.current_counts(spark, str(tmp_path / "out"))) == [("a/a", 5), ("b/b", 5), ("c/c", 1)]
    changed = spark.read.parquet(str(tmp_path / "out" / "changes")).where("word_key = 'a/a'").groupBy("epoch").count().count()
    assert changed == 2  # a batch writes the keys that it changes, no others


def test_costs_fall_with_use(spark):
    cost = [userdata.user_costs(spark.createDataFrame([("a/a", n), ("b/b", 5)], "key STRING, cnt BIGINT")).where("key = 'a/a'").first()["cost"] for n in (1, 2)]
    assert cost[0] > cost[1]
