"""Drafts as keyed state: the stream against a replay in order, over late and repeated events and a restart."""

from datetime import datetime, timedelta

import pytest

from driftloom.streaming import drafts

START = datetime(2024, 1, 1)
KIND = "draft string, seq long, ts timestamp, kind string, id string, path string, line int, body string, head string"


def event(draft, seq, minute, kind, id=None, body=None, head="h1"):
    return (draft, seq, START + timedelta(minutes=minute), kind, id, "a.py" if kind == "add" else None, 3 if kind == "add" else None, body, head)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, was)


def changes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[2]))


def streamed(spark, folder, batches, **how):
    """Each batch is a file; after every one the stream ends and is started again from its checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = drafts.draft_changes(source, "5 minutes", **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return changes(spark.read.schema(drafts.CHANGE).parquet(f"{folder}/out"))


def test_stream_equals_replay(rocksdb, tmp_path):
    first = [event("p", 1, 0, "add", body="one"), event("p", 3, 2, "edit", "d1", "uno"), event("q", 1, 1, "add", body="x", head=None)]
    second = [event("p", 2, 1, "add", body="two"), event("p", 3, 2, "edit", "d1", "again"), event("q", 2, 2, "discard", "d1"), event("q", 3, 3, "edit", "d9", "none")]
    third = [event("q", 4, 20, "add", body="new", head="h2"), event("p", 4, 21, "discard", "d2"), event("p", 5, 22, "add", body="three")]
    late = [event("p", 6, 3, "add", body="too late"), event("p", 5, 22, "add", body="twice"), event("p", 7, 40, "clear"), event("z", 1, 60, "add", body="moves the watermark")]
    last = [event("z", 2, 200, "add", body="end")]
    got = streamed(rocksdb, tmp_path, [first, second, third, late, last], idle=timedelta(days=1))
    in_time = first + [second[0], *second[2:]] + third + [late[2], late[3]]
    want = changes(drafts.replayed(rocksdb.createDataFrame(in_time, KIND)))
    assert got == want
    assert [(r[2], r[3], r[6]) for r in got if r[0] == "p"] == [("add", "d1", "one"), ("add", "d2", "two"), ("edit", "d1", "uno"), ("discard", "d2", "two"), ("add", "d3", "three"), ("clear", None, None)]
    # a draft that was empty counts from d1 again, with the new head
    assert [(r[2], r[3], r[7]) for r in got if r[0] == "q"] == [("add", "d1", None), ("discard", "d1", None), ("add", "d1", "h2")]


def test_idle_drafts_expire(rocksdb, tmp_path):
    rows = [[event("p", 1, 0, "add", body="one"), event("p", 2, 1, "add", body="two")], [event("z", 1, 30, "add", body="x")], [event("z", 2, 200, "add", body="y")], [event("z", 3, 400, "add", body="z")]]
    got = streamed(rocksdb, tmp_path, rows, idle=timedelta(minutes=60))
    assert [(r[1], r[2], r[8]) for r in got if r[0] == "p"] == [(-1, "expired", 0), (1, "add", 1), (2, "add", 2)]
    assert ("z", -1, "expired") in [r[:3] for r in got]


def test_replay_of_odd_rows(spark):
    assert drafts.replayed(spark.createDataFrame([], KIND)).count() == 0
    got = changes(drafts.replayed(spark.createDataFrame([event("p", 1, 0, "edit", "d1"), event("p", 2, 0, "unknown"), event("p", 3, 0, "clear"), event("p", 4, 1, "add"), event("p", 4, 9, "add")], KIND)))
    assert [(r[1], r[2], r[3]) for r in got] == [(4, "add", "d1")]
