"""Session-level operators over messages (session_id, msg_idx, role, content, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.operators.staging import materialise


def rollup(messages: DataFrame) -> DataFrame:
    """Message counts, first user and last assistant message, and times of each session."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.count_if(user).alias("user_messages"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("msg_idx"))).alias("first_user_message"),
        F.max_by(F.when(assistant, F.col("content")), F.when(assistant, F.col("msg_idx"))).alias("last_assistant_message"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )


def recent(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)


def group_by_project(sessions: DataFrame) -> DataFrame:
    """Projects in order of their latest session, with their sessions nested, newest first."""
    nested = F.reverse(F.array_sort(F.collect_list(F.struct("started_at", "session_id", "message_count"))))
    return sessions.groupBy("project_path").agg(nested.alias("sessions"), F.max("started_at").alias("latest")).withColumn("n_sessions", F.size("sessions"))


def shift_marks(messages: DataFrame, gap_seconds: int = P.TOPIC_GAP_SECONDS) -> DataFrame:
    """Messages with gap (seconds to the message before, of whatever role) and shift: whether a user changes the topic.

    A change is a gap of more than ``gap_seconds`` or a phrase in the first 500 characters.
    """
    before = F.lag("ts").over(Window.partitionBy("session_id").orderBy("msg_idx"))
    gapped = messages.withColumn("gap", (F.unix_micros("ts") - F.unix_micros(before)) / 1e6)
    phrase = C.any_of(F.substring(F.lower("content"), 1, 500), P.TOPIC_SHIFTS)
    return gapped.withColumn("shift", F.coalesce((F.col("role") == "user") & (phrase | F.coalesce(F.col("gap") > gap_seconds, F.lit(False))), F.lit(False)))


def topic_shifts(messages: DataFrame, gap_seconds: int = P.TOPIC_GAP_SECONDS) -> DataFrame:
    """Messages in which a user changes the topic: session_id, msg_idx, gap_seconds."""
    return shift_marks(messages, gap_seconds).where("shift").select("session_id", "msg_idx", F.round("gap", 3).alias("gap_seconds"))


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "2 hours") -> DataFrame:
    """Activity split where nothing happens for the gap."""
    out = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.drop("w")


def sampled(messages: DataFrame, head: int = 5, tail: int = 10, middle: int = 20, all_up_to: int = 30) -> DataFrame:
    """Messages that stand for a session: its first and last, those around shifts of topic, and every k-th of the others between.

    k is a ``middle``-th of the number of those others, at least 1; a session of up to ``all_up_to`` messages stays whole.
    """
    own = Window.partitionBy("session_id")
    line = own.orderBy("msg_idx")
    near = F.max(F.col("shift").cast("int")).over(line.rowsBetween(-2, 1))
    out = shift_marks(messages).select("session_id", "msg_idx", F.count("*").over(own).alias("n"), (F.row_number().over(line) - 1).alias("place"), near.alias("near"))
    kept = (F.col("place") < head) | (F.col("place") >= F.col("n") - tail) | (F.col("near") == 1)
    out = out.withColumn("kept", kept).withColumn("others", F.count_if(~F.col("kept")).over(own)).withColumn("other", F.count_if(~F.col("kept")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    every = F.greatest(F.lit(1), F.expr(f"others div {middle}"))
    return out.where((F.col("n") <= all_up_to) | F.col("kept") | (F.col("other") % every == 0)).select("session_id", "msg_idx")


def keyword_counts(messages: DataFrame, most: int = 30, least: int = 2, stopwords: list[str] = P.FUZZY_STOPWORDS) -> DataFrame:
    """The most frequent words of each session: session_id, term, n, rank."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))
    terms = messages.select("session_id", F.explode(words).alias("term")).where(~F.col("term").isin(stopwords))
    counted = terms.groupBy("session_id", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def outcomes(messages: DataFrame, last: int = 10) -> DataFrame:
    """What the assistant says came out, from the last messages of a session: session_id, outcome.

    The latest message that speaks of success and has, among its first three sentences, one of 21 to 199 characters that does.
    """
    late = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("msg_idx")))
    m = messages.withColumn("late", late).where((F.col("late") <= last) & (F.col("role") == "assistant") & C.any_of(F.lower("content"), P.OUTCOME_WORDS))
    sentences = F.filter(F.transform(F.slice(F.split("content", r"\."), 1, 3), C.strip), lambda s: (F.length(s) > 20) & (F.length(s) < 200) & C.any_of(F.lower(s), P.OUTCOME_SENTENCE_WORDS))
    said = m.select("session_id", "msg_idx", F.try_element_at(sentences, F.lit(1)).alias("outcome")).where("outcome is not null")
    return said.groupBy("session_id").agg(F.max_by("outcome", "msg_idx").alias("outcome"))


def summary(first: Column, outcome: Column, existing: Column | None = None) -> Column:
    """A session in a line: the summary it has if that is longer than 20 characters, else task and outcome."""
    first = C.strip(first)
    task = F.when(first != "", F.concat(F.lit("Task: "), C.truncate_words(first, 100, 50)))
    done = F.when(F.length(outcome) > 0, F.concat(F.lit("Outcome: "), outcome))
    made = F.when(task.isNotNull() | done.isNotNull(), F.concat_ws(" | ", task, done)).otherwise(F.lit("No summary available"))
    return made if existing is None else F.when(F.length(existing) > 20, existing).otherwise(made)


def document_text(parts: Column, most: int = 900) -> Column:
    """Parts joined by empty lines as far as they fit; a part that does not is left out, and later ones are still tried."""
    fold = F.aggregate(
        F.filter(parts, lambda p: p.isNotNull() & (p != "")), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size")),
        lambda s, p: F.when(s["size"] + F.length(p) + 2 <= most, F.struct(F.array_append(s["kept"], p).alias("kept"), (s["size"] + F.length(p) + 2).alias("size"))).otherwise(s),
    )
    return F.array_join(fold["kept"], "\n\n")


def metadata(messages: DataFrame, files: DataFrame | None = None, todos: DataFrame | None = None) -> DataFrame:
    """One row a session: summary, task_description, keywords, key_facts, accomplishments, todo_topics, message_count.

    ``files``: session_id, file_path; ``todos``: session_id, task.
    """
    from mnemospark.operators import extract

    listed = lambda rows, what: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(what).alias("x"))))["x"].alias("x"))
    user = F.col("role") == "user"
    messages = materialise(messages.select("session_id", "msg_idx", "role", "content"), "messages")  # each part reads them
    out = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min_by(F.when(user, F.col("content")), F.when(user, F.col("msg_idx"))).alias("first"))
    out = out.join(outcomes(messages), "session_id", "left")
    for name, rows in (
        ("keywords", listed(extract.keywords(messages, files=files), "term")), ("key_facts", listed(extract.facts(messages), "fact")), ("accomplishments", listed(extract.accomplishments(messages), "text")),
        ("todo_topics", (todos if todos is not None else messages.select("session_id", F.lit("").alias("task")).limit(0)).where("task <> ''").groupBy("session_id").agg(F.slice(F.array_sort(F.collect_set("task")), 1, 20).alias("x"))),
    ):
        out = out.join(rows.withColumnRenamed("x", name), "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select("session_id", summary(F.col("first"), F.col("outcome")).alias("summary"), C.clean_task(F.col("first")).alias("task_description"), "keywords", "key_facts", "accomplishments", "todo_topics", "message_count")


def documents(sessions: DataFrame) -> DataFrame:
    """The text that stands for a session in an index: session_id, text, from a row of ``metadata`` with the column git_branch."""
    part = lambda label, text, n, there: F.when(there, F.substring(F.concat(F.lit(f"{label}: "), text), 1, n))
    joined = lambda c, n, by: F.array_join(F.slice(c, 1, n), by)
    parts = F.array(
        part("Summary", F.col("summary"), 300, F.col("summary") != ""), part("Task", F.col("task_description"), 150, (F.col("task_description") != "") & (F.col("task_description") != F.col("summary"))),
        part("Keywords", joined("keywords", 20, ", "), 200, F.size("keywords") > 0), part("Tasks", joined("todo_topics", 5, "; "), 150, F.size("todo_topics") > 0),
        part("Facts", joined("key_facts", 3, " | "), 150, F.size("key_facts") > 0), part("Branch", F.col("git_branch"), 50, F.coalesce(F.col("git_branch"), F.lit("")) != ""),
    )
    return sessions.select("session_id", document_text(parts).alias("text"))
