"""A queue of work in a versioned table: items are leased to one owner each, and come back when a lease ends.

Every step is a transaction of the store, so that of two workers who ask at once one commits and the other asks again, on
what is left. Times are seconds, given by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.store import Store, Transaction

ITEMS = "item string, digest string, status string, attempts long, queued_at double, owner string, leased_until double"
HEALTH = "name string, failures long, paused_until double"


class WorkQueue:
    """Items are pending, leased, done or parked (after ``attempts`` tries). After ``most_failures`` in a row the queue pauses for ``pause`` seconds."""

    def __init__(self, store: Store, name: str = "queue", attempts: int = 3, most_failures: int = 5, pause: float = 60.0, buckets: int = 16):
        self.store, self.name, self.attempts, self.most_failures, self.pause, self.buckets = store, name, attempts, most_failures, pause, buckets

    def rows(self) -> DataFrame:
        return self._rows(self.store.snapshot())

    def _rows(self, at) -> DataFrame:
        return at.read(self.name) if self.name in at.tables else self.store.spark.createDataFrame([], ITEMS)

    def _health(self, at) -> tuple[int, float]:
        found = at.read(f"{self.name}_health").first() if f"{self.name}_health" in at.tables else None
        return (found["failures"], found["paused_until"]) if found else (0, 0.0)

    def _put(self, t: Transaction, rows: DataFrame) -> None:
        t.merge(self.name, rows, lambda old, new: old.join(new.select("item"), "item", "left_anti").unionByName(new), ["item"], self.buckets)

    def enqueue(self, items: DataFrame, now: float) -> int:
        """Queue (item, content). What is there with the same content stays as it is; other content queues the item anew. Of repeated items, the least content counts."""
        new = items.groupBy("item").agg(F.min(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("digest")).where("item is not null")

        def change(t: Transaction) -> None:
            known = self._rows(t).select("item", F.col("digest").alias("_digest"))
            fresh = new.join(known, "item", "left").where("_digest is null or _digest <> digest")
            none = lambda kind: F.lit(None).cast(kind)
            self._put(t, fresh.select("item", "digest", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(float(now)).alias("queued_at"), none("string").alias("owner"), none("double").alias("leased_until")))

        return self.store.update(change)

    def lease(self, owner: str, n: int, now: float, seconds: float = 300.0) -> list[str]:
        """Up to ``n`` items for this owner, the oldest first; none while the queue pauses. Items whose lease has ended have used up a try."""
        taken: list[str] = []

        def change(t: Transaction) -> None:
            taken.clear()
            rows = self._rows(t)
            ended = (F.col("status") == "leased") & (F.col("leased_until") <= now)
            tries = F.col("attempts") + ended.cast("long")
            now_rows = rows.withColumns({"attempts": tries, "status": F.when(ended, F.when(tries >= self.attempts, "parked").otherwise("pending")).otherwise(F.col("status"))})
            if self._health(t)[1] <= now:
                taken.extend(r["item"] for r in now_rows.where("status = 'pending'").orderBy("queued_at", "item").limit(n).select("item").collect())  # at most ``n``
            mine = F.col("item").isin(taken)
            some = rows.select("item").where(mine | ended)
            out = now_rows.join(some, "item", "left_semi").withColumns({"status": F.when(mine, "leased").otherwise(F.col("status")), "owner": F.when(mine, owner), "leased_until": F.when(mine, F.lit(float(now + seconds)))})
            self._put(t, out)

        if self.name in self.store.snapshot().tables:
            self.store.update(change)
        return list(taken)

    def finish(self, owner: str, results: dict[str, bool], now: float) -> list[str]:
        """What became of leased items: done, or failed. Items that the owner no longer has a lease on are left; gives those that counted."""
        counted: list[str] = []

        def change(t: Transaction) -> None:
            own = self._rows(t).where(F.col("item").isin(list(results)) & (F.col("owner") == owner) & (F.col("status") == "leased") & (F.col("leased_until") > now))
            counted[:] = sorted(r["item"] for r in own.select("item").collect())  # at most what was leased
            good = F.col("item").isin([i for i, ok in results.items() if ok])
            tries = F.col("attempts") + 1
            status = F.when(good, "done").when(tries >= self.attempts, "parked").otherwise("pending")
            self._put(t, own.withColumns({"status": status, "attempts": tries, "owner": F.lit(None).cast("string"), "leased_until": F.lit(None).cast("double")}))
            failures, paused = self._health(t)
            for item in counted:
                failures = 0 if results[item] else failures + 1
                if failures >= self.most_failures:
                    failures, paused = 0, now + self.pause
            t.write(f"{self.name}_health", self.store.spark.createDataFrame([(self.name, failures, float(paused))], HEALTH), ["name"], 1)

        self.store.update(change)
        return counted
