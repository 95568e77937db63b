"""Structured Streaming over messages and operations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.staging import shared_dir
from mnemospark.sources.store import Store, Transaction


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """The events table as a stream with event time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path}*")  # a file or a folder of files
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    out = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "ids")


def sessionised(stream: DataFrame, gap: str = "2 hours") -> DataFrame:
    out = stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def sliding(stream: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    out = stream.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "n")


def transcript_stream(spark: SparkSession, root: str) -> DataFrame:
    """Lines of new transcript files below a folder, as they come: session_id, last_modified, data (variant). Files grow by new increments."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").format("text").load(root)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return lines.select(F.regexp_replace(name, r"\.jsonl$", "").alias("session_id"), F.col("_metadata.file_modification_time").alias("last_modified"), F.try_parse_json("value").alias("data")).where("data is not null")


def settled(changes: DataFrame, key: str, ts: str = "ts", quiet: str = "5 seconds") -> DataFrame:
    """Bursts of changes of a file that are followed by quiet: key, first_change, last_change, changes. A burst is one piece of work."""
    out = changes.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("changes"), F.max(ts).alias("last_change"))
    return out.select(key, F.col("w.start").alias("first_change"), "last_change", "changes")


def fresh(messages: DataFrame, key: str = "session_id", place: str = "msg_idx") -> DataFrame:
    """Messages beyond the last one seen of their session, however often its file is read again: key, place. State holds one number a session."""
    kind = messages.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -1
        new = sorted({int(p) for batch in batches for p in batch[place] if p > seen})
        if new:
            state.update((new[-1],))
        yield pd.DataFrame({key: [name[0]] * len(new), place: new})

    return messages.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {place} long", "last long", "append", "NoTimeout")


def waiting(changes: DataFrame, key: str, ttl: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Entries that changed, and those that no change came for within ``ttl`` of event time, which state forgets: key, status, changes.

    ``changes`` needs a watermark on ``ts``.
    """
    kind, length = changes.schema[key].dataType.simpleString(), pd.Timedelta(ttl)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [name[0]], "status": ["expired"], "changes": [n]})
            return
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n, last = n + len(batch), max(last, int(batch[ts].max().timestamp() * 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + int(length.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "status": ["pending"], "changes": [n]})

    return changes.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, status string, changes long", "n long, last long", "update", "EventTimeTimeout")


def progress(query) -> list[dict]:
    """What the last batches of a running stream did: batch, rows, rows a second, seconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"], "seconds": p["batchDuration"] / 1000} for p in query.recentProgress]


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(keys)


def running_counts(stream: DataFrame) -> DataFrame:
    """Messages, first and last event of each user, carried in state from batch to batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for batch in batches:
            n += len(batch)
            low, high = int(batch["event_id"].min()), int(batch["event_id"].max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        state.update((n, first, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first_event": [first], "last_event": [last]})

    kept, out = "n long, first_event long, last_event long", "user_id long, n long, first_event long, last_event long"
    return stream.groupBy("user_id").applyInPandasWithState(update, out, kept, "update", "NoTimeout")


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, and return what it wrote, from a table below ``checkpoint``.

    Every batch is written under its number, so that a batch that runs again replaces itself. With ``key``, the row of the
    last batch of each key counts.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    if key:
        rest = [c for c in out.columns if c not in (*key, "batch")]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
        return out
    return out.drop("batch")


def ingest(stream: DataFrame, checkpoint: str, stages: dict, target: str | Store, name: str = "ingest") -> None:
    """Write the tables that ``stages`` derive from each batch of messages, so that a batch may run again.

    In a store, a batch is one version: ``stages`` give for each table its key, what a batch gives, and how that is merged with
    what is there. A batch that was committed changes nothing when it runs again, and one that failed has left nothing. Below
    a plain folder, each table of a batch is written under the batch's number; ``stages`` are functions of the batch then.
    """

    def batch(rows: DataFrame, number: int) -> None:
        def change(t: Transaction) -> None:
            if not t.seen(name, number):
                for table, (key, derive, how) in stages.items():
                    t.merge(table, derive(rows), how, key)

        rows = rows.persist()
        if isinstance(target, Store):
            target.update(change)
        else:
            for table, stage in stages.items():
                stage(rows).write.mode("overwrite").parquet(f"{target}/{table}/batch={number:09d}")
        rows.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def folder(spark: SparkSession) -> str:
    """Where streams keep their state: the shared folder."""
    return shared_dir(spark)
