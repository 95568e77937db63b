"""Folds in order of place, done in parallel: running counts over hot keys, and first-come groups of similar rows in rounds."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators.staging import discard, materialise

#: Nodes that one task decides in order.
BLOCK = 20_000


def running_count(rows: DataFrame, key: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """``rows`` with the number of flagged rows (or the sum of whole numbers) of the same key at or before each, by ``order``.

    Rows are dealt out by ranges of key and order, so that a hot key lies in many tasks; counts go from range to range with
    one row a key and range. Rows equal in key and order count as one place: flags among them count for all of them.
    """
    cut = materialise(rows.repartitionByRange(key, *order).withColumn("slice", F.spark_partition_id()).withColumn("flag", flag.cast("int")), "slices")
    inside = F.sum("flag").over(Window.partitionBy("slice", key).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(key, "slice").agg(F.sum("flag").alias("flags")).select(key, "slice", F.coalesce(F.sum("flags").over(earlier), F.lit(0)).alias("before"))
    return cut.withColumn("inside", inside).join(before, [key, "slice"]).withColumn(name, F.col("before") + F.col("inside")).drop("slice", "flag", "inside", "before")


def alive(first: Column, born: Column, end: Column, own: Column) -> Column:
    """Whether a group that starts at ``born`` and ends after ``end`` takes rows at ``first``; its own rows from ``born`` on."""
    return ((born < first) | (own & (born == first))) & (end.isNull() | (first <= end))


def latest_alive(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """``asked`` (id, other, first, more) with the group of kind ``other`` (id, born, end, more) that is alive at ``first``, if there is one.

    Groups of one kind are near each other, so that no two are alive at once: only the latest before ``first`` can be. Births before
    a place are counted, and the group with that number is joined, so that each row meets one group, however many a kind has.
    """
    own, births = F.col("id") == F.col("other"), groups.select(F.col("id").alias("other"), F.col("born").alias("place")).distinct()
    rows = asked.withColumn("side", F.when(own, 2).otherwise(0)).withColumnRenamed("first", "place")
    marks = births.select("other", "place", F.lit(1).alias("side"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in ("other", "first")])
    counted = materialise(running_count(rows.unionByName(marks), "other", ["place", "side"], F.col("side") == 1, "nth"), "counted")
    named = counted.where("side = 1").select("other", F.col("place").alias("born"), "nth").join(groups.withColumnRenamed("id", "other"), ["other", "born"])
    found = counted.where("side <> 1").drop("side").withColumnRenamed("place", "first").join(named, ["other", "nth"]).drop("nth")
    return found.where(alive(F.col("first"), F.col("born"), F.col("end"), own))


def _decide(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a block in order: one starts a group (True) if no group near it is alive, or waits (False) if that is open."""
    near: dict[int, list[int]] = {}
    for a, b in zip(edges["kind"], edges["near"], strict=True):
        near.setdefault(a, []).append(b)
    begun: dict[int, tuple] = {}
    waiting: dict[int, tuple] = {}
    verdicts: list[tuple] = []
    place = lambda p: None if p is None else tuple(p.values() if isinstance(p, dict) else p)
    rows = sorted(zip(map(place, nodes["first"]), nodes["id"], map(place, nodes["end"]), nodes["node"], nodes["blocked"], strict=True), key=lambda r: r[0])
    lives = lambda group, first: group[0] < first and (group[1] is None or first <= group[1])
    for first, wording, end, node, blocked in rows:
        around = near.get(wording, [wording])
        if any(lives(begun[o], first) for o in around if o in begun):
            continue
        if blocked or any(lives(waiting[o], first) for o in around if o in waiting):
            if wording not in waiting or waiting[wording][1] != end:  # of an earlier span nothing lives on
                waiting[wording] = (first, end)
            verdicts.append((node, False))
        else:
            begun[wording] = (first, end)
            verdicts.append((node, True))
    return pd.DataFrame(verdicts, columns=["node", "starts"])


def first_come(nodes: DataFrame, near: DataFrame, block: int = BLOCK) -> DataFrame:
    """Which nodes start a group, taken in order of ``first``: id, born, end.

    ``nodes`` (id, first, end): something of kind ``id`` that comes at ``first``; a group it starts takes what is near up to
    ``end`` (null: for ever). ``near`` (id, other, both ways, each id with itself): which kinds are near each other. A node
    starts a group unless one near it is alive. Nodes of one place don't see each other.

    Nodes are cut into ranges of ``first`` of about ``block`` nodes. In a round, every range decides in order all nodes
    whose fate hangs on decided ones alone; what a new group takes elsewhere goes to it by a join. A node waits only for
    undecided ones near and before it, so rounds are few where order has little to do with likeness, and never more than
    ranges; a chain in order takes a round a range. No task holds more than a range and the links inside it.
    """
    count = nodes.count()
    ranges = max(1, -(-count // block))
    open_ = nodes.repartitionByRange(ranges, "first").withColumn("block", F.spark_partition_id()).withColumn("node", F.monotonically_increasing_id())
    open_ = materialise(open_, "nodes")
    begun: list[DataFrame] = []
    while True:
        held = open_.withColumn("blocked", F.lit(False))
        if ranges > 1:
            here = open_.groupBy(F.col("id").alias("other"), "block").agg(F.max(F.col("end").isNull()).alias("ever"), F.max("end").alias("until"))
            places = open_.select("block", "id").distinct().join(near, "id").select("other", "block").distinct().join(here, ["other", "block"], "full")
            earlier = Window.partitionBy("other").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a kind and range
            before = places.select("other", "block", F.coalesce(F.max("ever").over(earlier), F.lit(False)).alias("ever"), F.max("until").over(earlier).alias("until"))
            waits = open_.join(near, "id").join(before, ["other", "block"]).where(F.col("ever") | (F.col("first") <= F.col("until")))
            held = open_.join(waits.select("node", F.lit(True).alias("w")).distinct(), "node", "left").withColumn("blocked", F.coalesce("w", F.lit(False))).drop("w")
        kinds = open_.select("block", "id").distinct()
        edges = kinds.join(near, "id").join(kinds.select("block", F.col("id").alias("other")), ["block", "other"])
        edges = edges.select(F.col("block").alias("of"), F.col("id").alias("kind"), F.col("other").alias("near"))
        said = held.groupBy("block").cogroup(edges.groupBy("of")).applyInPandas(lambda n, e: _decide(n, e), "node long, starts boolean")
        done = materialise(open_.join(said, "node"), "decided")
        groups = done.where("starts").select("id", F.col("first").alias("born"), "end")
        begun.append(groups)
        rest = done.where("not starts").drop("starts")
        discard(open_)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, begun)
        taken = latest_alive(rest.select("node", "id", "first").join(near, "id"), groups)
        open_ = materialise(rest.join(taken.select("node").distinct(), "node", "left_anti"), "nodes")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, begun)
