"""File history: timelines, snapshots as of a time, edits of an interval, reconstruction by an ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C


def snapshots(ops: DataFrame) -> DataFrame:
    """What writes leave: operation_id, content, line_count, byte_size."""
    return ops.where("op = 'write'").select(F.col("event_id").alias("operation_id"), "content", C.line_count(F.col("content")).cast("long").alias("line_count"), F.octet_length("content").cast("long").alias("byte_size"))


def timeline(ops: DataFrame, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Operations, with lines and bytes of what they wrote if they wrote a file, newest first. ``path``: a LIKE pattern, whatever the case."""
    out = ops if path is None else ops.where(F.ilike("file_path", F.lit(path)))
    sizes = snapshots(out).select(F.col("operation_id").alias("event_id"), "line_count", "byte_size")
    out = out.select("event_id", "session_id", "op", "file_path", "ts").join(sizes, "event_id", "left")
    return out if limit is None else out.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def symbol_history(ops: DataFrame, symbol: str | None = None, limit: int | None = None) -> DataFrame:
    """Where symbols are defined, by a join of symbols, snapshots and operations: symbol_name, symbol_type, line_number, file_path, session_id, event_id, ts."""
    found = symbols(ops) if symbol is None else symbols(ops).where(F.contains(F.lower("symbol_name"), F.lit(symbol.lower())))
    made = snapshots(ops).select("operation_id")
    done = ops.select(F.col("event_id").alias("operation_id"), "file_path", "session_id", "ts")
    out = found.join(made, "operation_id").join(done, "operation_id").withColumnRenamed("operation_id", "event_id")
    return out if limit is None else out.orderBy(F.desc("ts"), "file_path", "line_number").limit(limit)


def symbols(ops: DataFrame) -> DataFrame:
    """Functions and classes that written files define: operation_id, symbol_type, symbol_name, line_number."""
    lines = ops.where("op = 'write'").select(F.col("event_id").alias("operation_id"), F.posexplode(F.split("content", "\n")).alias("line", "text"))
    name = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    function, kind = name(r"^\s*(?:async\s+)?(?:def|function|func|fn)\s+(\w+)"), name(r"^\s*(?:class|struct|interface)\s+(\w+)")
    out = lines.select("operation_id", F.when(function.isNotNull(), "function").otherwise("class").alias("symbol_type"), F.coalesce(function, kind).alias("symbol_name"), (F.col("line") + 1).cast("long").alias("line_number"))
    return out.where("symbol_name is not null")


def snapshot_as_of(ops: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (file_path, target) the last write not after it: target_id, file_path, target, snapshot_ts, content.

    Writes and targets of a file's day meet in one sort by time, and the last write is carried on; where a day has none
    before the target, that of the last earlier day counts, which goes from day to day with one row a file and day. So a
    file with very many writes is spread over its days, and no pair of write and target is formed.
    """
    day = F.to_date("ts")
    writes = ops.where("op = 'write'").select("file_path", "ts", F.lit(0).alias("side"), "event_id", F.struct("ts", "event_id").alias("w"), F.lit(None).cast("long").alias("target_id"))
    asked = targets.select("file_path", F.col("target").alias("ts"), F.lit(1).alias("side"), F.lit(None).cast(ops.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(writes.schema["w"].dataType).alias("w"), "target_id")
    line = Window.partitionBy("file_path", "day").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = writes.unionByName(asked).withColumn("day", day)
    days = both.groupBy("file_path", "day").agg(F.max("w").alias("last"))
    before = Window.partitionBy("file_path").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("file_path", "day", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = both.withColumn("own", F.last("w", ignorenulls=True).over(line)).where("side = 1").join(carried, ["file_path", "day"])
    found = found.select("target_id", "file_path", F.col("ts").alias("target"), F.coalesce("own", "carried").alias("w"))
    contents = ops.where("op = 'write'").select(F.col("event_id").alias("wrote"), "content")
    return found.join(contents, found["w.event_id"] == contents["wrote"], "left").select("target_id", "file_path", "target", F.col("w.ts").alias("snapshot_ts"), "content")


def edits_between(ops: DataFrame, spans: DataFrame) -> DataFrame:
    """Edits with start < ts <= end of a file's spans (span_id, file_path, start, end), by an equi-join on file and day."""
    edits = ops.where("op = 'edit'").withColumn("day", F.to_date("ts"))
    days = spans.where("start < end").withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    return edits.join(days, ["file_path", "day"]).where("ts > start and ts <= end").select("span_id", "file_path", "event_id", "ts", "old_string", "new_string")


def apply_edits(content: Column, edits: Column) -> Column:
    """Fold edits (old_string, new_string, replace_all) into a text: struct of content, applied, failed."""
    zero = F.struct(content.alias("content"), F.lit(0).alias("applied"), F.lit(0).alias("failed"))

    def one(s: Column, e: Column) -> Column:
        at = F.position(e["old_string"], s["content"])
        first = F.concat(F.substring(s["content"], F.lit(1), at - 1), e["new_string"], F.substring(s["content"], at + F.length(e["old_string"]), F.length(s["content"])))
        new = F.when(e["replace_all"], F.replace(s["content"], e["old_string"], e["new_string"])).otherwise(first)
        hit = (at > 0) & (F.length(e["old_string"]) > 0)
        return F.struct(F.when(hit, new).otherwise(s["content"]).alias("content"), (s["applied"] + hit.cast("int")).alias("applied"), (s["failed"] + (~hit).cast("int")).alias("failed"))

    return F.aggregate(edits, zero, one)


def reconstruct(ops: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Each file as its last write and the edits after it make it: file_path, content, edits_applied, edits_failed, confidence."""
    ops = ops if as_of is None else ops.where(F.col("ts") <= as_of)
    last = ops.where("op = 'write'").groupBy("file_path").agg(F.max_by(F.struct("ts", "event_id", "content"), F.struct("ts", "event_id")).alias("w"))
    edits = ops.where("op = 'edit'").join(last, "file_path").where("struct(ts, event_id) > struct(w.ts, w.event_id)")
    listed = edits.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "old_string", "new_string", "replace_all"))).alias("edits"))
    none = F.array().cast(listed.schema["edits"].dataType)
    out = last.join(listed, "file_path", "left").withColumn("r", apply_edits(F.col("w.content"), F.coalesce("edits", none)))
    total = F.col("r.applied") + F.col("r.failed")
    confidence = F.when(total > 0, F.round(0.95 * F.col("r.applied") / total, 4)).otherwise(0.95)
    return out.select("file_path", F.col("r.content").alias("content"), F.col("r.applied").cast("long").alias("edits_applied"), F.col("r.failed").cast("long").alias("edits_failed"), confidence.alias("confidence"))


def journey(ops: DataFrame) -> DataFrame:
    """One row: created, edited and unique files, lines written."""
    return ops.agg(
        F.count_if(F.col("op") == "write").alias("files_written"), F.count_if(F.col("op") == "edit").alias("edits"), F.count_distinct("file_path").alias("unique_files"),
        F.expr("cast(coalesce(sum(length(coalesce(content, new_string))), 0) div 40 as bigint)").alias("lines"),
    )


def most_active(ops: DataFrame, limit: int = 10) -> DataFrame:
    out = ops.groupBy("file_path").agg(F.count_if(F.col("op") == "write").alias("writes"), F.count_if(F.col("op") == "edit").alias("edits"), F.max("ts").alias("last_ts"))
    return out.orderBy(F.desc(F.col("writes") + F.col("edits")), "file_path").limit(limit)


def recent_files(ops: DataFrame, limit: int = 15) -> DataFrame:
    """Distinct files, the latest touched first."""
    return ops.groupBy("file_path").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "file_path").limit(limit)


def totals(ops: DataFrame) -> DataFrame:
    """One row: operations, snapshots, edits, files."""
    return ops.agg(
        F.count("*").alias("total_operations"), F.count_if((F.col("op") == "write") & F.col("content").isNotNull()).alias("snapshots"), F.count_if((F.col("op") == "edit") & F.col("old_string").isNotNull()).alias("edits"),
        F.count_distinct("file_path").alias("unique_files"),
    )


def shown_changes(ops: DataFrame, limit: int = 20, most: int = 200) -> DataFrame:
    """Edits, newest first, before and after cut with a mark of the cut."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    over = lambda c: F.coalesce(F.length(c) > most, F.lit(False))
    rows = ops.where("op = 'edit'").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
    return rows.select("event_id", "file_path", "ts", cut("old_string").alias("before"), cut("new_string").alias("after"), over("old_string").alias("before_truncated"), over("new_string").alias("after_truncated"))
