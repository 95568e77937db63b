"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents stand in the order of that key; a distributed
prefix sum of their sizes says where each begins and ends; the source's budget cuts this line exactly, after as many
whole epochs as the budget holds. The prefix sum has two levels: keys are cut into equal ranges, ranges are summed
before any shuffle, and only documents of one range of one source meet in a task, so that a hot source is spread over
as many tasks as its size asks for.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import WORD, discard, materialise, unused

KEY_BITS = 60
#: A range of keys holds about so many documents of the largest source, more where there would be more ranges than ``RANGES``.
RANGE_ROWS, RANGES = 256, 100_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: str = "1.5", most: int = 2) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size): ``share`` of all sizes dealt by weight, at most ``most`` times a source's size.

    Sources in code point order, null last, take the weights in turn. A source above its limit stops there, and what is
    over is dealt again by weight among the others until none is above. Sources may be many: ranks come from a range sort
    and the counts of its partitions, and every round of dealing is one sum over the sources.
    """
    given = sources.select(F.col("source").isNull().alias("last"), "source", "source_size").repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    given = materialise(given, "sources")
    counts = {r["part"]: r["n"] for r in given.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one a partition
    begin, at = {}, 0
    for part in sorted(counts):
        begin[part], at = at, at + counts[part]
    before = F.element_at(F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]), F.col("part")) if begin else F.lit(0)
    rank = before + F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = materialise(given.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("limit")), "sources")
    discard(given)
    budget, old = Fraction(share) * int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]), None
    full = F.lit(False)
    while True:
        sums = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)).alias("open"), F.count_if(full).alias("full")).first()
        left, open_ = budget - int(sums["taken"]), int(sums["open"])
        if not open_ or sums["full"] == old:
            break
        # limit <= w * left / open, in whole numbers
        old, full = sums["full"], F.col("limit").cast("decimal(38,0)") * F.lit(open_ * left.denominator) <= F.col("w").cast("decimal(38,0)") * F.lit(left.numerator)
    dealt = F.lit(float(left)) * F.col("w") / F.lit(max(1, open_))
    return ranked.select("source", "source_size", F.when(full | F.lit(open_ == 0), F.col("limit").cast("double")).otherwise(dealt).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: str = "1.5", most: int = 2) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies.

    size is the number of words (null text: 0). taken is the number of words the mix takes from the document: its size
    once an epoch, and in the last epoch, for the one document at the cut, the part before the cut. The sum of taken over
    a source is its target rounded down. copies says how often a mix of whole documents takes it: the document at the cut
    counts if at least half of it lies before the cut. Null sources are a source of their own; null ids sort first;
    repeated rows each take part; an empty table gives no rows.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"),
        ),
        "sizes",
    )
    found = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    goals = targets(found, weights, share, most)
    ranges = max(1, min(RANGES, -(-(found.agg(F.max("n")).first()[0] or 0) // RANGE_ROWS)))
    width = -(-(1 << KEY_BITS) // ranges)
    sized = sized.withColumn("range", F.expr(f"key div {width}"))

    within = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = before.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(within), F.lit(0)).alias("before"))
    line = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    goals = goals.withColumnRenamed("source", "s")
    budget, total = F.floor("target"), F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / total).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * total - F.col("before") - F.col("ahead")))
    return placed.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("long").alias("taken"),
        (epochs + F.when((rest > 0) & (2 * rest >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken (``copies``), with all its columns.

    Rows that repeat id, source and size are taken alike, each as often as the one of them taken most. Null ids, sources
    and texts are values like others; an empty table gives no rows.
    """
    key, source, size, times, again = unused(docs, "key", "mix_source", "mix_size", "times", "again")
    plan = mix(docs, id_col, text_col, source_col, **rules).groupBy("doc_id", "source", "size").agg(F.max("copies").alias(times))
    plan = plan.where(F.col(times) > 0).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), times)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    on = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)) & (words == F.col(size))
    return docs.join(plan, on).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
