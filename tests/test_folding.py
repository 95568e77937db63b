"""Folds in order of place, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import folding, profile
from tests.test_operators import _plain_rules

FOUND = "session_id long, msg_idx long, at int, rule_type string, rule_text string, scope string, confidence double"


def test_running_count_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randrange(400), rng.random() < 0.3) for _ in range(1500)]
    rows.append((None, 1, True))
    df = spark.createDataFrame(rows, "k string, o long, f boolean")
    out = folding.running_count(df.where("k is not null"), "k", ["o"], F.col("f"), "n")
    assert sorted(out.columns) == ["f", "k", "n", "o"]
    want = sorted((k, o, f, sum(1 for a, b, g in rows if a == k and b <= o and g)) for k, o, f in rows if k is not None)
    assert sorted((r.k, r.o, r.f, r.n) for r in out.collect()) == want


def test_a_chain_of_100000_in_order(spark):
    """Each is like the one before and after it: every second one starts a group, and no task sees more than a range."""
    n = 100_000
    ids = spark.range(n)
    nodes = ids.select("id", F.struct(F.lit("s").alias("session_id"), F.col("id").alias("msg_idx")).alias("first"))
    nodes = nodes.withColumn("end", F.lit(None).cast(nodes.schema["first"].dataType))
    near = ids.select("id", F.explode(F.array(F.col("id") - 1, F.col("id"), F.col("id") + 1)).alias("other")).where(f"other between 0 and {n - 1}")
    out = folding.first_come(nodes, near)
    assert out.agg(F.count("*"), F.count_if(F.col("id") % 2 == 0), F.count_distinct("id")).first() == (n // 2, n // 2, n // 2)


@pytest.mark.parametrize("block", [3, 40])
def test_first_come_in_ranges_is_the_plain_loop(spark, block):
    rng = random.Random(block)
    links = {(a, b) for a in range(30) for b in range(a) if rng.random() < 0.12}
    near = sorted(links | {(b, a) for a, b in links} | {(a, a) for a in range(30)})
    times: dict[int, list[int]] = {a: sorted(rng.sample(range(500), 3)) for a in range(30)}
    until = lambda a, t: next((e for e in times[a] if e >= t), None)
    nodes = [(rng.randrange(30), t) for t in rng.sample(range(600), 120)]
    nodes = [(a, t, until(a, t)) for a, t in nodes]
    df = spark.createDataFrame([(a, (t,), None if e is None else (e,)) for a, t, e in nodes], "id long, first struct<t:long>, end struct<t:long>")
    got = sorted((r.born.t, r.id) for r in folding.first_come(df, spark.createDataFrame(near, "id long, other long"), block).collect())
    want: list[tuple] = []
    for a, t, e in sorted(nodes, key=lambda x: x[1]):
        if not any((a, b) in set(near) and born < t and (end is None or t <= end) for born, b, end in want):
            want.append((t, a, e))
    assert got == sorted((t, a) for t, a, _ in want)


def test_rules_over_ranges_ties_and_nulls(spark):
    rng = random.Random(9)
    pool = ["keep modules small", "keep modules small now", "keep all modules small", "keep all modules small now", "squash commits early"]
    rules = [(1 + i // 30, i, 0, rng.choice(["always", "prefer"]), rng.choice(pool), None, rng.choice([0.5, 0.7, 0.8])) for i in range(60)]
    ends = [(1 + i // 30, i, 0, sorted(set(rng.choice(pool).split()))) for i in range(0, 60, 7)]
    odd = [(1, 3, 1, "always", "", None, 0.8), (1, 3, 2, "always", None, None, 0.8), (1, 3, 3, None, "keep it", None, 0.8)]
    found, gone = spark.createDataFrame(rules + odd, FOUND), spark.createDataFrame(ends + [(1, 5, 1, []), (1, 5, 2, None)], "session_id long, msg_idx long, at int, words array<string>")
    got = sorted((r.rule_type, r.rule_text, r.frequency, round(r.confidence, 6), r.revoked) for r in profile.learned_rules(found, gone, block=7).collect())
    assert got == _plain_rules([((s, i, a), k, t, set(t.split()), c) for s, i, a, k, t, _, c in rules], [((s, i, a), set(w)) for s, i, a, w in ends])


def test_a_kind_with_many_groups_meets_each_row_once(spark):
    """Groups of one kind that end and start anew: a row finds the one alive at its place, own ones from their birth on."""
    groups = [(k, (10 * i,), (10 * i + 4 + k,)) for k in (0, 1) for i in range(200)] + [(0, (2000,), None)]
    asked = [(n, n % 3, n % 2, (n * 7 % 2100,)) for n in range(600)]
    schema = "id long, born struct<t:long>, end struct<t:long>"
    out = folding.latest_alive(spark.createDataFrame(asked, "n long, id long, other long, first struct<t:long>"), spark.createDataFrame(groups, schema))
    want = sorted((n, b[0]) for n, i, o, (t,) in asked for k, b, e in groups if k == o and (b[0] < t or i == o and b[0] == t) and (e is None or t <= e[0]))
    assert sorted((r.n, r.born.t) for r in out.collect()) == want
