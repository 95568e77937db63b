"""Timers by the clock, running sessions, state that expires."""

import time

from pyspark.sql import functions as F

from mnemospark.sources.store import Store
from mnemospark.streaming import stateful

SCHEMA = "session_id string, role string, ts timestamp"


def added(spark, folder, *rows):
    said = spark.createDataFrame([(s, r, i) for s, r, i in rows], "session_id string, role string, s long")
    said.select("session_id", "role", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def waited(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.5)
    return condition()


def test_release_without_a_further_event(spark, tmp_path):
    folder = str(tmp_path / "in")
    added(spark, folder, ("a", "u", 10), ("a", "u", 12), ("b", "u", 11))
    stream = stateful.released(spark.readStream.schema(SCHEMA).parquet(folder), "session_id", quiet=3.0)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").format("memory").queryName("freed").start()
    try:
        told = lambda: sorted((r.session_id, r.first_change.timestamp(), r.last_change.timestamp(), r.changes) for r in spark.sql("select * from freed").collect())
        assert waited(lambda: len(told()) == 2) and told() == [("a", 10.0, 12.0, 2), ("b", 11.0, 11.0, 1)]
        added(spark, folder, ("a", "u", 20))
        assert waited(lambda: len(told()) == 3) and told()[1] == ("a", 20.0, 20.0, 1)
    finally:
        query.stop()


def test_running_sessions_and_expiry(spark, tmp_path):
    """Rows are rewritten while sessions run; an expired session leaves no state and begins anew."""
    folder, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))

    def run():
        messages = spark.readStream.schema(SCHEMA).parquet(folder)
        stateful.keep_sessions(messages, str(tmp_path / "c"), store, idle=20.0).trigger(once=True).start().awaitTermination()
        return sorted((r.session_id, r.messages, r.user_messages, r.started_at.timestamp(), r.last_at.timestamp()) for r in store.snapshot().read("sessions").collect())

    added(spark, folder, ("a", "user", 1), ("a", "assistant", 2), ("b", "user", 3))
    assert run() == [("a", 2, 1, 1.0, 2.0), ("b", 1, 1, 3.0, 3.0)]
    added(spark, folder, ("a", "user", 9))
    assert run() == [("a", 3, 2, 1.0, 9.0), ("b", 1, 1, 3.0, 3.0)]
    time.sleep(21)
    added(spark, folder, ("b", "user", 30))
    assert run() == [("a", 3, 2, 1.0, 9.0), ("b", 1, 1, 30.0, 30.0)]
    held = spark.read.format("statestore").option("stateVarName", "session").load(str(tmp_path / "c"))
    assert [r.key.session_id for r in held.collect()] == ["b"]


def test_first_seen(spark, tmp_path):
    folder = str(tmp_path / "in")
    added(spark, folder, ("a", "u", 1), ("a", "u", 2), ("b", "u", 1))
    stream = stateful.first_seen(spark.readStream.schema(SCHEMA).parquet(folder), "session_id")
    for _ in range(2):
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        added(spark, folder, ("b", "u", 5), ("c", "u", 5))
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
