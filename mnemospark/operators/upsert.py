"""Merges of new rows into tables, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_merge(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """New values take the place of old ones where they are known; columns in ``overwrite`` always, if the key is new or again there."""
    overwrite = overwrite or []
    n = new.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(n.alias("n"), key, "full_outer")
    rest = [c for c in old.columns if c not in key]
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in overwrite else F.coalesce(f"n.{c}", f"o.{c}")
    return joined.select(*key, *[pick(c).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new rows whose key is not there yet, each key once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(key), key, "left_anti"))


def accumulate(old: DataFrame, new: DataFrame, key: list[str], step: float = 0.1) -> DataFrame:
    """Frequencies added up, confidences raised by a step for each further sighting, last sight and sessions kept."""
    both = old.unionByName(new)
    return both.groupBy(*key).agg(
        F.sum("frequency").alias("frequency"), F.least(F.lit(1.0), F.max("confidence") + step * (F.count("*") - 1)).alias("confidence"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_sessions")))).alias("source_sessions"),
    )


#: How the columns of a table take in new sightings.
DECISIONS = {"decision": "first", "reasoning": "last", "category": "first", "confidence": "max", "last_seen": "max"}
CONCEPTS = {"description": "first", "frequency": "sum", "confidence": "max", "last_seen": "max"}
ERRORS = {"error_type": "first", "normalised_message": "first", "solution_summary": "last", "occurrence_count": "sum", "last_seen": "max", "source_sessions": "tail"}
ZONES = {"issue_count": "sum", "description": "last", "last_seen": "max", "source_sessions": "tail"}
NAMES = {"confidence": "max", "pattern": "last"}


def merge(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Old and new rows of one key as one: a column is added up (sum), its largest (max), its first or last known value, or the last ten different elements of both lists (tail)."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_side"))
    ways = {
        "sum": F.sum, "max": F.max, "first": lambda c: F.min_by(c, known(c)), "last": lambda c: F.max_by(c, known(c)),
        "tail": lambda c: _tail(F.flatten(F.array_sort(F.collect_list(F.struct("_side", F.coalesce(c, F.array()).alias("x"))))["x"]), 10),
    }
    return both.groupBy(*key).agg(*[ways[how](c).alias(c) for c, how in rules.items()])


def _tail(items, n: int):
    once = F.array_distinct(items)
    return F.slice(once, F.greatest(F.lit(1), F.size(once) - n + 1), F.lit(n))


def lifecycles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lifecycle patterns (description, frequency, confidence): a further sighting gives the mean of both confidences and 0.05 more."""
    n = new.select("description", F.col("frequency").alias("f"), F.col("confidence").alias("c"))
    joined = old.join(n, "description", "full_outer")
    mean = F.when(F.col("confidence").isNotNull() & F.col("c").isNotNull(), F.least(F.lit(1.0), (F.col("confidence") + F.col("c")) / 2 + 0.05))
    return joined.select("description", (F.coalesce("frequency", F.lit(0)) + F.coalesce("f", F.lit(0))).alias("frequency"), F.coalesce(mean, "confidence", "c").alias("confidence"))


def finished(queue: DataFrame, done: DataFrame, failed: DataFrame, attempts: int = 3) -> DataFrame:
    """A queue after a batch: items in ``done`` are done, those in ``failed`` have one attempt more and give up at ``attempts``."""
    d, f = done.select("item", F.lit(True).alias("_done")).distinct(), failed.select("item", F.lit(True).alias("_failed")).distinct()
    out = queue.join(d, "item", "left").join(f, "item", "left").withColumn("attempts", F.col("attempts") + F.when(F.col("_failed"), 1).otherwise(0))
    return out.withColumn("status", F.when(F.col("_done"), "done").when(F.col("_failed") & (F.col("attempts") >= attempts), "failed").otherwise(F.col("status"))).drop("_done", "_failed")


def swept(queue: DataFrame, as_of, days: int = 7) -> DataFrame:
    """A queue without items that have been done for more than ``days``."""
    return queue.where(~((F.col("status") == "done") & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days)))))


def projects(paths: DataFrame) -> DataFrame:
    """One row a project: by its remote if it has one, else by its path."""
    from mnemospark.functions.columns import normalise_remote

    remote = F.nullif(normalise_remote(F.col("git_remote")), F.lit(""))
    out = paths.withColumn("git_remote", remote).withColumn("project_key", F.coalesce("git_remote", "path"))
    return out.groupBy("project_key").agg(F.min("path").alias("path"), F.max("git_remote").alias("git_remote"), F.min("created_at").alias("created_at"))


def next_in_queue(queue: DataFrame, limit: int, attempts: int = 3) -> DataFrame:
    """The oldest entries that have not failed too often."""
    return queue.where(F.col("attempts") < attempts).orderBy("queued_at", "item").limit(limit)
