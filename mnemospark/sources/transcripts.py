"""Transcript files: JSON lines whose messages hold a string or a list of blocks.

Lines are read as VARIANT, as the content has no fixed type; blank and malformed lines fall away. Everything downstream is
typed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "struct<type:string,text:string,name:string,input:struct<file_path:string,path:string,content:string,old_string:string,new_string:string,replace_all:boolean,todos:array<struct<content:string,task:string,status:string>>>>"


def discover(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Transcript files below a folder: session_id, file_path, project, last_modified, is_agent; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "session_id string, file_path string, project string, last_modified timestamp, is_agent boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("path", "modificationTime")
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    out = files.select(stem.alias("session_id"), F.col("path").alias("file_path"), F.element_at(parts, -2).alias("project"), F.col("modificationTime").alias("last_modified"), F.startswith(stem, F.lit("agent-")).alias("is_agent"))
    if project is not None:
        out = out.where(F.ltrim(F.col("project"), F.lit("-")) == project.replace("/", "-").lstrip("-"))
    return out


def changed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files of users that are new or not as they were when they were read: those of agents and unchanged ones are left.

    ``files``: session_id, last_modified, is_agent; ``done``: session_id, last_modified.
    """
    read = done.select("session_id", F.col("last_modified").alias("_read"))
    return files.where("not is_agent").join(read, "session_id", "left").where("_read is null or _read <> last_modified").drop("_read")


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every JSON object with its place: session_id, project, line (of the file, from 0, blank and malformed ones counted), last_modified, data (variant)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    parts = F.split("_metadata.file_path", "/")
    out = lines.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("session_id"), F.element_at(parts, -2).alias("project"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_modification_time").alias("last_modified"),
        F.try_parse_json("value").alias("data"),
    )
    number = F.row_number().over(Window.partitionBy("path").orderBy("block", "at")) - 1  # a block is read by one task, in order
    return out.withColumn("line", number.cast("long")).where("data is not null").drop("path", "block", "at")


def typed(lines: DataFrame) -> DataFrame:
    """The typed fields of raw lines; ``text`` is the content, or the texts of its blocks joined by line ends."""
    get = lambda path, kind="string": F.try_variant_get("data", path, kind)
    plain = F.schema_of_variant(F.try_variant_get("data", "$.message.content", "variant")) == "STRING"
    items = F.try_variant_get("data", "$.message.content", "array<variant>")
    text_of = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string"))
    listed = F.array_join(F.filter(F.transform(items, text_of), lambda t: t.isNotNull()), "\n")
    blocks = F.transform(F.filter(items, lambda b: F.startswith(F.schema_of_variant(b), F.lit("OBJECT"))), lambda b: F.from_json(F.to_json(b), BLOCK))
    return lines.select(
        "session_id", "project", "line", "last_modified", get("$.type").alias("type"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), get("$.slug").alias("slug"),
        get("$.gitBranch").alias("git_branch"), get("$.cwd").alias("cwd"), get("$.summary").alias("summary"), get("$.message.model").alias("model"),
        F.coalesce(F.when(plain, get("$.message.content")).otherwise(listed), F.lit("")).alias("text"), blocks.alias("blocks"),
    )


def messages(lines: DataFrame) -> DataFrame:
    """User and assistant messages with text: session_id, msg_idx, role, content, ts, model."""
    said = typed(lines).where(F.col("type").isin("user", "assistant") & (F.trim("text") != ""))
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("line")) - 1
    return said.select("session_id", index.cast("long").alias("msg_idx"), F.col("type").alias("role"), F.col("text").alias("content"), "ts", "model")


def tool_blocks(lines: DataFrame) -> DataFrame:
    """Tool uses: session_id, line, block, ts, tool, input."""
    out = typed(lines).where("blocks is not null").select("session_id", "line", "ts", F.posexplode("blocks").alias("block", "b"))
    return out.where("b.type = 'tool_use'").select("session_id", "line", "block", "ts", F.col("b.name").alias("tool"), F.col("b.input").alias("input"))


def tool_usage(lines: DataFrame) -> DataFrame:
    """Per session: uses of each tool, and the sorted files they name."""
    used = tool_blocks(lines)
    counts = used.groupBy("session_id", "tool").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools_used"))
    file = F.coalesce("input.file_path", F.when(F.col("tool") == "Glob", F.col("input.path")))
    files = used.groupBy("session_id").agg(F.array_sort(F.collect_set(file)).alias("files_touched"))
    return counts.join(files, "session_id", "left")


def todos(lines: DataFrame) -> DataFrame:
    """Todo entries of TodoWrite blocks: session_id, line, place, task, status."""
    out = tool_blocks(lines).where("tool = 'TodoWrite'").select("session_id", "line", F.posexplode("input.todos").alias("place", "t"))
    out = out.select("session_id", "line", "place", F.coalesce("t.content", "t.task").alias("task"), F.coalesce("t.status", F.lit("pending")).alias("status"))
    return out.where("task <> ''")


def file_operations(lines: DataFrame) -> DataFrame:
    """Writes and edits of files: session_id, seq, op, file_path, content, old_string, new_string, replace_all, ts."""
    use = tool_blocks(lines).where("(tool = 'Write' and input.content is not null) or (tool = 'Edit' and input.old_string is not null)").where("input.file_path is not null")
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("line", "block")) - 1
    return use.select(
        "session_id", seq.cast("long").alias("seq"), F.lower("tool").alias("op"), F.col("input.file_path").alias("file_path"), F.when(F.col("tool") == "Write", F.col("input.content")).alias("content"),
        F.when(F.col("tool") == "Edit", F.col("input.old_string")).alias("old_string"), F.when(F.col("tool") == "Edit", F.coalesce("input.new_string", F.lit(""))).alias("new_string"),
        F.coalesce("input.replace_all", F.lit(False)).alias("replace_all"), "ts",
    )


def sessions(lines: DataFrame) -> DataFrame:
    """One row a session: counts, last summary, first user message, first slug, branch and folder, models, times."""
    t = typed(lines)
    said = F.col("type").isin("user", "assistant") & (F.trim("text") != "")
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("line")))
    user = (F.col("type") == "user") & (F.trim("text") != "")
    return t.groupBy("session_id", "project").agg(
        F.count_if(said).alias("message_count"), F.max_by("summary", F.when(F.col("type") == "summary", F.col("line"))).alias("summary"),
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("line"))).alias("first_user_message"), first("slug").alias("slug"), first("git_branch").alias("git_branch"),
        first("cwd").alias("cwd"), F.array_sort(F.collect_set("model")).alias("models_used"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )
