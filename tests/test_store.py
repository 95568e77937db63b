"""Versioned tables: whole versions, races, batches, merges in buckets, lookups."""

import threading

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import upsert
from mnemospark.sources.store import Conflict, Store, touched
from mnemospark.streaming import queries as streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r])


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_versions_stay_as_they_are(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.snapshot().tables == {}
    store.update(lambda t: t.write("a", table(spark, (1, "x"), (2, "y"), (None, "n")), ["k"], 4))
    store.update(lambda t: t.merge("a", table(spark, (2, "z"), (3, "w")), lambda old, new: upsert.coalesce_merge(old, new, ["k"])))
    store.update(lambda t: t.delete("a", table(spark, (1, None))))
    assert [rows(store.snapshot(v).read("a")) for v in (1, 2)] == [[(1, "x"), (2, "y"), (None, "n")], [(1, "x"), (2, "z"), (3, "w"), (None, "n")]]
    assert rows(store.snapshot().read("a")) == [(2, "z"), (3, "w"), (None, "n")]
    with pytest.raises(ValueError, match="no version 9"):
        store.snapshot(9)


def test_merge_rewrites_only_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda t: t.write("a", table(spark, *((i, str(i)) for i in range(200))), ["k"], 32))
    new = table(spark, (7, "seven"), (8, "eight"))
    store.update(lambda t: t.merge("a", new, lambda old, n: upsert.coalesce_merge(old, n, ["k"])))
    before, after = (store.snapshot(v).tables["a"].files for v in (1, 2))
    assert {b for b in after if after[b] != before.get(b)} == touched(new, ["k"], 32)
    assert dict(rows(store.snapshot().read("a"))) == {i: str(i) for i in range(200)} | {7: "seven", 8: "eight"}
    found = store.snapshot().lookup("a", new)
    assert rows(found) == [(7, "seven"), (8, "eight")]
    files = {f.split("/_version=")[1].split("/")[1] for f in found.inputFiles()}
    assert files == {f"_bucket={b}" for b in touched(new, ["k"], 32)}


def test_two_writers_race_and_one_retries(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda t: t.write("a", table(spark, (0, "0")), ["k"], 4))
    first, second = store.begin(), store.begin()
    first.merge("a", table(spark, (1, "1")), lambda old, new: upsert.insert_ignore(old, new, ["k"]))
    second.merge("a", table(spark, (2, "2")), lambda old, new: upsert.insert_ignore(old, new, ["k"]))
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert rows(store.snapshot().read("a")) == [(0, "0"), (1, "1")]

    tries, barrier = [], threading.Barrier(2)

    def change(n):
        def run(t):
            t.merge("a", table(spark, (n, "r")), lambda old, new: upsert.insert_ignore(old, new, ["k"]))
            if n not in tries:
                barrier.wait(60)
            tries.append(n)

        store.update(run)

    threads = [threading.Thread(target=change, args=(n,)) for n in (5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(tries) == 3  # one of them twice
    assert rows(store.snapshot().read("a")) == [(0, "0"), (1, "1"), (5, "r"), (6, "r")] and store.versions() == [1, 2, 3, 4]


def test_batch_that_dies_between_two_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))

    def batch(number, die=False):
        def change(t):
            if t.seen("stream", number):
                return
            t.merge("a", table(spark, (number, "a")), lambda old, new: old.union(new), ["k"], 4)
            if die:
                raise OSError("lost")
            t.merge("b", table(spark, (number, "b")), lambda old, new: old.union(new), ["k"], 4)

        store.update(change)

    batch(0)
    with pytest.raises(OSError, match="lost"):
        batch(1, die=True)
    assert (rows(store.snapshot().read("a")), rows(store.snapshot().read("b"))) == ([(0, "a")], [(0, "b")])
    for _ in range(2):  # again, and once more than needed
        batch(1)
    assert (rows(store.snapshot().read("a")), rows(store.snapshot().read("b"))) == ([(0, "a"), (1, "a")], [(0, "b"), (1, "b")])
    folders = len(list((tmp_path / "s" / "data").glob("*/_version=*")))
    assert store.vacuum(keep=1, older_than=-60) == folders - len({f for t in store.snapshot().tables.values() for f in t.files.values()})
    assert rows(store.snapshot().read("a")) == [(0, "a"), (1, "a")]


def test_empty_tables_and_folders_within(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda t: t.write("a", table(spark), ["k"], 4))
    assert rows(store.snapshot().read("a")) == [] and store.snapshot().read("a").columns == ["k", "v"]
    store.update(lambda t: t.write("w", table(spark, *((i, f"p{i % 3}") for i in range(9))), ["k"], 2, within=["v"]))
    some = store.snapshot().read("w").where("v = 'p1'")
    assert rows(some) == [(1, "p1"), (4, "p1"), (7, "p1")] and "PartitionFilters: [isnotnull(v" in some._jdf.queryExecution().toString()


def test_ingest_commits_all_tables_of_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    schema = "session_id long, n long"
    store = Store(spark, str(tmp_path / "s"))
    tables = {
        "sessions": (["session_id"], lambda b: b.groupBy("session_id").agg(F.sum("n").alias("n")), lambda old, new: old.union(new).groupBy("session_id").agg(F.sum("n").alias("n"))),
        "rows": (["session_id", "n"], lambda b: b, lambda old, new: upsert.insert_ignore(old, new, ["session_id", "n"])),
    }
    for part in (((1, 2), (2, 3)), ((1, 5), (3, 1))):
        spark.createDataFrame(list(part), schema).coalesce(1).write.mode("append").parquet(str(source))
        streams.ingest(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "state"), tables, store, "test")
    assert rows(store.snapshot().read("sessions")) == [(1, 7), (2, 3), (3, 1)]
    assert rows(store.snapshot().read("rows")) == [(1, 2), (1, 5), (2, 3), (3, 1)] and store.snapshot().batches == {"test": 1}
