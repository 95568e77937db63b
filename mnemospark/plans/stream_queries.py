"""Registered queries: streams of files that grow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.staging import materialise, shared_dir
from mnemospark.plans.registry import LINES, query
from mnemospark.sources import tail as tails
from mnemospark.sources.store import Store
from mnemospark.sources.tables import lines
from mnemospark.streaming import queries as streams
from mnemospark.streaming import stateful


def _transcripts(given: DataFrame) -> DataFrame:
    """The text of each session's transcript: project, session_id, text."""
    line = F.struct("line", F.to_json("data").alias("value"))
    lines_ = F.array_sort(F.collect_list(line))["value"]
    return given.groupBy("project", "session_id").agg(F.concat(F.array_join(lines_, "\n"), F.lit("\n")).alias("text"))


def _written(transcripts: DataFrame, folder: str, share: float) -> None:
    """Write the first ``share`` of the bytes of each session's transcript, most often half a line at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = tails.opened(folder)
        made: set[str] = set()
        for batch in batches:
            for project, session, text in batch[["project", "session_id", "text"]].itertuples(index=False, name=None):
                if project not in made:
                    fs.create_dir(f"{base}/{project}")
                    made.add(project)
                data = text.encode()
                with fs.open_output_stream(f"{base}/{project}/{session}.jsonl") as f:
                    f.write(data[: int(len(data) * share)])
            yield pd.DataFrame({"files": [len(batch)]})

    transcripts.mapInPandas(run, "files long").agg(F.sum("files")).first()


@query(f"WITH {LINES} SELECT session_id, project, count(*) AS n_lines, count(*) FILTER (WHERE event_type = 'view') AS n_summaries FROM l GROUP BY ALL")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that grow between the runs of a stream, which cuts lines in two; every line comes once, whole."""
    folder = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    given, store = materialise(_transcripts(lines(spark, sf_dir)), "transcripts"), Store(spark, f"{folder}/store")
    for share in (0.37, 0.8, 1.0):
        _written(given, f"{folder}/in", share)
        found = tails.transcript_tail(spark, f"{folder}/in", f"{folder}/offsets").select("session_id", "project", "line", F.try_variant_get("data", "$.type", "string").alias("type"))
        streams.ingest(found, f"{folder}/state", {"lines": (["session_id"], lambda b: b, lambda old, new: old.union(new))}, store, "tail")
    return store.snapshot().read("lines").groupBy("session_id", "project").agg(F.count("*").alias("n_lines"), F.count_if(F.col("type") == "summary").alias("n_summaries"))


@query("""SELECT user_id, count(*) AS messages, count(*) FILTER (WHERE event_type IN ('error', 'click', 'signup')) AS user_messages, date_trunc('millisecond', min(ts)) AS started_at, date_trunc('millisecond', max(ts)) AS last_at FROM events GROUP BY user_id""")
def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions rewritten in a store's table while they run."""
    store, folder = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), f"{shared_dir(spark)}/running-{uuid.uuid4().hex}"
    role = F.when(F.col("event_type").isin("error", "click", "signup"), "user").otherwise("assistant")
    said = streams.event_stream(spark, sf_dir).select("user_id", "ts", role.alias("role"))
    stateful.keep_sessions(said, folder, store, "sessions", "user_id").trigger(once=True).start().awaitTermination()
    return store.snapshot().read("sessions")
