"""Status figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_buckets(messages: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Sessions by their number of messages: none, at most two, more; of more, those of ``agents`` (session_id) apart."""
    n = messages.groupBy("session_id").agg(F.count_if(F.col("role").isin("user", "assistant")).alias("n"))
    n = n.withColumn("agent", F.lit(False)) if agents is None else n.join(agents.select("session_id", F.lit(True).alias("agent")).distinct(), "session_id", "left")
    bucket = F.when(F.col("n") == 0, "no_messages").when(F.col("n") <= 2, "minimal").when(F.col("agent"), "agents").otherwise("sessions")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_messages"))


def progress(buckets: DataFrame, indexed: Column) -> DataFrame:
    """One row: total, indexed, pending, percent, complete."""
    total = F.sum(F.when(F.col("bucket") == "sessions", F.col("n_sessions")).otherwise(0))
    out = buckets.agg(total.alias("total")).withColumn("indexed", F.least(indexed, F.col("total")))
    percent = F.when(F.col("total") > 0, F.round(100.0 * F.col("indexed") / F.col("total"), 1)).otherwise(100.0)
    return out.select("total", "indexed", F.greatest(F.lit(0), F.col("total") - F.col("indexed")).alias("pending"), percent.alias("percent"), (F.col("indexed") >= F.col("total")).alias("complete"))


def counts(rows: DataFrame, column: str, other: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit(other)).alias(column)).agg(F.count("*").alias("n"))


def archive_stats(archives: DataFrame, text: str) -> DataFrame:
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return archives.agg(F.count("*").alias("archives"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 4).alias("avg_bytes"))


def files_per_project(files: DataFrame, limit: int = 5) -> DataFrame:
    return files.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(limit)


def by_project(artifacts: DataFrame, projects: DataFrame) -> DataFrame:
    """Artifacts of each project and type, and of all (project_path null)."""
    own = artifacts.join(projects.select("session_id", "project_path"), "session_id").groupBy("project_path", "artifact_type").agg(F.count("*").alias("n"))
    return own.unionByName(artifacts.groupBy("artifact_type").agg(F.count("*").alias("n")).withColumn("project_path", F.lit(None).cast("string")))


def decision_stats(decisions: DataFrame, sure: float = 0.8) -> DataFrame:
    """One row: total, sure ones, categories."""
    return decisions.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= sure).alias("high_confidence"), F.count_distinct("category").alias("categories"))


def error_stats(errors: DataFrame) -> DataFrame:
    """One row: patterns, those with a solution, occurrences."""
    return errors.agg(F.count("*").alias("total"), F.count_if(F.col("solution_summary").isNotNull()).alias("with_solution"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).cast("long").alias("occurrences"))


def operation_stats(ops: DataFrame, top: int = 10) -> DataFrame:
    """Figures of file operations as rows (section, name, n): total, files, operations by kind, the busiest files."""
    row = lambda section, name, n: (F.lit(section).alias("section"), name.alias("name"), n.alias("n"))
    totals = ops.agg(F.count("*").alias("t"), F.count_distinct("file_path").alias("f")).select(F.explode(F.array(F.struct(*row("total", F.lit("operations"), F.col("t"))), F.struct(*row("total", F.lit("files"), F.col("f"))))).alias("r")).select("r.*")
    kinds = ops.groupBy("op").agg(F.count("*").alias("n")).select(*row("by_type", F.col("op"), F.col("n")))
    files = ops.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(top).select(*row("top_files", F.col("file_path"), F.col("n")))
    return totals.unionByName(kinds).unionByName(files)


def outcomes(rows: DataFrame, status: str) -> DataFrame:
    """How many items of a batch ended in each way."""
    return counts(rows, status, "pending")


def versions(known: DataFrame, applied: DataFrame) -> DataFrame:
    """One row on a schema's versions: the current one, how many are applied, how many of the known ones are not."""
    done = applied.where("success").select("version")
    pending = known.join(done, "version", "left_anti").agg(F.count("*").alias("pending"))
    return done.agg(F.max("version").alias("current"), F.count("*").alias("applied")).crossJoin(pending)  # one row each
