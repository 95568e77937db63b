"""Given tables, and the transcript view that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.sources.samples import SENTENCES

NAMES = ["Alice", "Bruno", "Carla", "Dmitri", "Elena"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a UTC timestamp and the number k of their properties."""
    out = table(spark, sf_dir, "events")
    return out.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of sessions: session_id, msg_idx, event_id, event_type, role, ts, k, content.

    A session is a user, its messages stand in order of time. Purchases carry a decision, clicks a code block or a rule,
    errors an error, views a solution, signups an introduction.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type")
    count = parts.agg(F.count("*").alias("parts"))
    e = events(spark, sf_dir).crossJoin(F.broadcast(count))  # one row: the number of parts
    e = e.withColumn("part", F.col("event_id") % F.col("parts")).join(parts, "part", "left")
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    kind, k, user, event = F.col("event_type"), F.col("k"), F.col("user_id"), F.col("event_id")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (user % len(NAMES) + 1).cast("int"))
    content = (
        F.when(kind == "error", text("TypeError: bad value ", k, " at /srv/app/m", user % 7, ".py line ", event % 100))
        .when(kind == "purchase", text("Decision: use ", F.col("p_name"), " for ", F.col("p_type")))
        .when(kind == "view", text("The fix is: restart worker ", user % 5, " and clear the ", k, " cache"))
        .when((kind == "click") & (event % 2 == 0), text("See this\n```python\ndef f", k, "(x):\n    return x + ", k, "\n```\n"))
        .when(kind == "click", text("never commit straight into release", k % 10, " branches, issue in src/m", user % 7, ".py"))
        .otherwise(text("Hello, my name is ", name, "."))
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    role = F.when(kind.isin("error", "click", "signup"), "user").otherwise("assistant")
    return e.select(
        user.alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("msg_idx"), "event_id", "event_type", role.alias("role"), "ts", "k", content.alias("content")
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File operations: purchases write a file of two lines, clicks edit it."""
    e = events(spark, sf_dir).where("event_type in ('purchase', 'click')")
    path = F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit(".py"))
    k = F.col("k").cast("string")
    write = F.col("event_type") == "purchase"
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), F.when(write, "write").otherwise("edit").alias("op"), path.alias("file_path"), "ts",
        F.when(write, F.concat(F.lit("a = "), k, F.lit("\nb = "), (F.col("k") % 10).cast("string"))).alias("content"),
        F.when(~write, F.concat(F.lit("b = "), (F.col("k") % 10).cast("string"))).alias("old_string"),
        F.when(~write, F.concat(F.lit("b = "), (F.col("k") % 7).cast("string"))).alias("new_string"),
        (F.col("event_id") % 3 == 0).alias("replace_all"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of sessions; their days follow from the session's number."""
    c = table(spark, sf_dir, "conversations")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") % 365 * 86400)
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_idx"), "role", F.col("text").alias("content"), start.alias("ts"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events told in the sentences of ``samples``: session_id, msg_idx, event_id, role, ts, content. A session is a user's eight days."""
    e = events(spark, sf_dir)
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SENTENCES]), (F.col("event_id") % len(SENTENCES) + 1).cast("int"))
    path = F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit(".py"))
    content = F.replace(F.replace(pick(1), F.lit("{k}"), F.col("k").cast("string")), F.lit("{p}"), path)
    e = e.withColumn("session_id", F.col("user_id") * 4 + F.floor((F.dayofmonth("ts") - 1) / 8))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1
    return e.select("session_id", place.cast("long").alias("msg_idx"), "event_id", pick(0).alias("role"), "ts", content.alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed transcript lines, as ``transcripts.raw_lines`` gives them: session_id, project, line, last_modified, data.

    Errors are user messages of text; clicks messages of text blocks, bare strings and an edit; purchases write a file;
    signups read one and note two tasks; views are summaries.
    """
    e = events(spark, sf_dir)
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    time = F.concat(F.lit('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z",'))
    path = text("src/m", user % 7, ".py")
    said = text('{"type":"assistant",', time, '"message":{"model":"m', k % 2, '","content":[')
    line = (
        F.when(kind == "error", text('{"type":"user",', time, '"gitBranch":"b', k % 3, '","message":{"content":"failed with code ', k, '"}}'))
        .when(kind == "click", text(said, '{"type":"text","text":"edit ', k, '"},"bare ', k, '",{"type":"tool_use","name":"Edit","input":{"file_path":"', path, '","old_string":"a', k, '","new_string":"b"}}]}}'))
        .when(kind == "purchase", text(said, '{"type":"tool_use","name":"Write","input":{"file_path":"', path, '","content":"c', k, '"}}]}}'))
        .when(kind == "view", text('{"type":"summary","summary":"seen ', F.col("event_id"), '"}'))
        .otherwise(text(said, '{"type":"tool_use","name":"Glob","input":{"path":"', path, '"}},{"type":"tool_use","name":"TodoWrite","input":{"todos":[{"content":"task ', k, '","status":"done"},{"content":"task ', k + 1, '"},{"content":""}]}}]}}'))
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    project = text("-home-p", user % 3)
    return e.select(user.cast("string").alias("session_id"), project.alias("project"), place.cast("long").alias("line"), "ts", F.try_parse_json(line).alias("data")).withColumnRenamed("ts", "last_modified")
