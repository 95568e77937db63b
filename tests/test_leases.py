"""A queue of work: one owner an item, crashes, parked items, pauses."""

import threading

from mnemospark.operators.leases import WorkQueue
from mnemospark.sources.store import Store


def items(spark, *names, content="x"):
    return spark.createDataFrame([(n, f"{content}{n}") for n in names], "item string, content string")


def told(queue):
    return {r["item"]: (r["status"], r["attempts"], r["owner"]) for r in queue.rows().collect()}


def test_crash_returns_the_item_and_the_third_failure_parks_it(spark, tmp_path):
    queue = WorkQueue(Store(spark, str(tmp_path / "s")), buckets=2)
    assert queue.lease("w", 5, 0.0) == []
    queue.enqueue(items(spark, "a", "b"), 1.0)
    queue.enqueue(items(spark, "a"), 2.0)  # the same content
    assert queue.lease("w1", 1, 10.0, 30.0) == ["a"] and queue.lease("w2", 5, 11.0, 300.0) == ["b"] and queue.lease("w3", 5, 12.0) == []
    assert queue.finish("w3", {"a": True}, 13.0) == []  # not its own
    assert queue.lease("w3", 5, 41.0, 30.0) == ["a"]  # w1 was lost
    assert queue.finish("w1", {"a": True}, 42.0) == [] and told(queue)["a"] == ("leased", 1, "w3")
    assert queue.finish("w3", {"a": False}, 43.0) == ["a"] and told(queue)["a"] == ("pending", 2, None)
    assert queue.lease("w4", 1, 50.0) == ["a"] and queue.finish("w4", {"a": False}, 51.0) == ["a"]
    assert queue.finish("w2", {"b": True}, 52.0) == ["b"]
    assert told(queue) == {"a": ("parked", 3, None), "b": ("done", 1, None)} and queue.lease("w5", 5, 60.0) == []
    queue.enqueue(items(spark, "a", "b", content="y"), 70.0)  # other content
    assert queue.lease("w5", 5, 71.0) == ["a", "b"]


def test_pause_after_five_failures(spark, tmp_path):
    queue = WorkQueue(Store(spark, str(tmp_path / "s")), attempts=9, pause=60.0, buckets=2)
    queue.enqueue(items(spark, *"abcdef"), 1.0)
    got = queue.lease("w", 5, 2.0)
    assert queue.finish("w", dict.fromkeys(got, False), 3.0) == got
    assert queue.lease("w", 5, 62.0) == [] and len(queue.lease("w", 9, 63.0)) == 6


def test_two_workers_never_share_an_item(spark, tmp_path):
    queue, got = WorkQueue(Store(spark, str(tmp_path / "s")), buckets=2), {}
    queue.enqueue(items(spark, *"abcd"), 1.0)

    def work(name):
        got[name] = queue.lease(name, 2, 5.0)

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x for v in got.values() for x in v) == list("abcd")
    assert {i: o for i, (_, _, o) in told(queue).items()} == {x: w for w, v in got.items() for x in v}
