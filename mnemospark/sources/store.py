"""Versioned tables: immutable files, a manifest for each version, and commits that succeed for one writer only.

A store is a folder. ``data`` holds what was written, never changed afterwards; ``log`` holds a JSON manifest for each
version, which lists the files of every table. A transaction writes new files first and then its manifest under the next
number, which fails if another writer was there before. So a version is whole or is not there, over all tables together,
and readers of a version see neither half a batch nor later ones.

The rows of a table lie in buckets of its key. A merge reads and writes only the buckets that its rows fall into, and a
lookup by key reads only that key's bucket.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemospark.operators.staging import shuffles_removed

BUCKET = "_bucket"
#: A key of this name is the number of the bucket itself.
SHARD = "_shard"


class Conflict(RuntimeError):
    """Another writer committed the version that this transaction was to make."""


@dataclass(frozen=True)
class Table:
    """A table of one version: its key, columns, number of buckets, folders within them, and the folder of each bucket that has rows."""

    key: tuple[str, ...]
    schema: str
    buckets: int
    within: tuple[str, ...] = ()
    files: dict[int, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = str(self._fs.makeQualified(path).toString())

    # --- the log -----------------------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def versions(self) -> list[int]:
        log = self._path("log")
        if not self._fs.exists(log):
            return []
        names = (PurePosixPath(s.getPath().toString()).name for s in self._fs.listStatus(log))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "batches": {}}
        file = self._fs.open(self._path("log", f"{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode())
        finally:
            file.close()

    def _put(self, version: int, manifest: dict) -> None:
        """Write a manifest unless its version is there: the whole file is moved in place, which fails for all but the first."""
        whole, target = self._path("log", f".{uuid.uuid4().hex}"), self._path("log", f"{version:020d}.json")
        out = self._fs.create(whole, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":  # a rename on a local disk would replace the other's; a link doesn't
                jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, whole)))
            else:
                none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                kinds = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                kinds[0] = none
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, target, kinds)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} is there already") from None
            raise
        finally:
            if self._fs.exists(whole):
                self._fs.delete(whole, False)

    # --- reading -----------------------------------------------------------------------------------------------------
    def snapshot(self, version: int | None = None) -> Snapshot:
        """The store as of a version, by default the last."""
        known = self.versions()
        number = version if version is not None else max(known, default=0)
        if number and number not in known:
            raise ValueError(f"there is no version {number}")
        return Snapshot(self, number, self.manifest(number))

    # --- writing -----------------------------------------------------------------------------------------------------
    def begin(self) -> Transaction:
        return Transaction(self.snapshot())

    def update(self, change: Callable[[Transaction], None], tries: int = 10, pause: float = 0.1) -> int:
        """Run ``change`` on a transaction and commit it; on a conflict, again on what the other writer left. Gives the version."""
        for n in range(tries):
            transaction = self.begin()
            change(transaction)
            try:
                return transaction.commit()
            except Conflict:
                if n == tries - 1:
                    raise
                time.sleep(pause * 2**n)
        raise AssertionError("tries is at least 1")

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Remove versions but the last ``keep``, and files that no kept version lists and that are older than so many seconds, which no running transaction needs. Gives the number of folders removed."""
        known = self.versions()
        for version in known[: max(0, len(known) - keep)]:
            self._fs.delete(self._path("log", f"{version:020d}.json"), False)
        used = {folder for v in known[-keep:] for t in self.manifest(v)["tables"].values() for folder in t["files"].values()}
        removed, limit = 0, time.time() - older_than
        data = self._path("data")
        for name in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(name.getPath()):
                if folder.getPath().toString() not in used and folder.getModificationTime() / 1000 < limit:
                    self._fs.delete(folder.getPath(), True)
                    removed += 1
        return removed


class Snapshot:
    """Tables of one version."""

    def __init__(self, store: Store, version: int, manifest: dict):
        self.store, self.version, self.spark = store, version, store.spark
        self.batches: dict[str, int] = dict(manifest["batches"])
        self.tables = {n: Table(tuple(t["key"]), t["schema"], t["buckets"], tuple(t["within"]), {int(b): f for b, f in t["files"].items()}) for n, t in manifest["tables"].items()}

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        return self._read(self.tables[name], None if buckets is None else set(buckets))

    def _read(self, table: Table, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        paths = [f"{folder}/{BUCKET}={b}" for b, folder in sorted(table.files.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = paths[0].rsplit("/", 2)[0]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*[f.name for f in schema.fields])

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys, read from their buckets alone. The distinct buckets go through the driver, the keys do not."""
        table = self.tables[name]
        return self._read(table, touched(keys, table.key, table.buckets)).join(keys.select(*table.key).distinct(), list(table.key), "left_semi")


def bucket(key: Iterable[str], buckets: int):
    key = list(key)
    return F.pmod(F.col(SHARD) if key == [SHARD] else F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, key: Iterable[str], buckets: int) -> set[int]:
    """Buckets that rows fall into: at most as many as there are."""
    return {r[0] for r in rows.select(bucket(key, buckets)).distinct().collect()}


class Transaction(Snapshot):
    """Changes to a snapshot, which nobody sees before ``commit``. Reads see what this transaction wrote."""

    def __init__(self, base: Snapshot):
        super().__init__(base.store, base.version, {"tables": {}, "batches": base.batches})
        self.tables = dict(base.tables)

    def _written(self, name: str, rows: DataFrame, key: tuple[str, ...], buckets: int, within: tuple[str, ...]) -> dict[int, str]:
        """Write rows in their buckets, and list those that got any."""
        folder = f"{self.store.root}/data/{name}/_version={uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, bucket(key, buckets))
        with shuffles_removed(self.spark):
            placed.repartition(BUCKET, *within).sortWithinPartitions(BUCKET, *within, *key).write.partitionBy(BUCKET, *within).option("compression", "zstd").parquet(folder)
        path = self.store._path("data", name, folder.rsplit("/", 1)[1])
        names = (PurePosixPath(s.getPath().toString()).name for s in self.store._fs.listStatus(path))
        return {int(n.split("=")[1]): folder for n in names if n.startswith(f"{BUCKET}=")}

    def write(self, name: str, rows: DataFrame, key: Iterable[str], buckets: int = 16, within: Iterable[str] = ()) -> None:
        """Make or replace a table. Inside a bucket, ``within`` names columns whose values get folders of their own."""
        key, within = tuple(key), tuple(within)
        self.tables[name] = Table(key, rows.schema.json(), buckets, within, self._written(name, rows, key, buckets, within))

    def replace(self, name: str, rows: DataFrame, buckets: Iterable[int]) -> None:
        """Put rows in place of all that these buckets hold; rows must fall into them."""
        t = self.tables[name]
        kept = {b: f for b, f in t.files.items() if b not in set(buckets)}
        self.tables[name] = Table(t.key, t.schema, t.buckets, t.within, kept | self._written(name, rows.select(*[f["name"] for f in json.loads(t.schema)["fields"]]), t.key, t.buckets, t.within))

    def merge(self, name: str, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], key: Iterable[str] | None = None, buckets: int = 16) -> None:
        """Merge rows into a table by ``how(old, new)``, as those of ``operators.upsert``, bucket by bucket. A table that is not there is made, with ``key``."""
        if name not in self.tables:
            if key is None:
                raise ValueError(f"there is no table {name}, and no key to make it")
            self.tables[name] = Table(tuple(key), rows.schema.json(), buckets)
        t = self.tables[name]
        some = touched(rows, t.key, t.buckets)
        if some:
            self.replace(name, how(self._read(t, some), rows), some)

    def delete(self, name: str, keys: DataFrame) -> None:
        t = self.tables[name]
        some = touched(keys, t.key, t.buckets)
        if some:
            self.replace(name, self._read(t, some).join(keys.select(*t.key).distinct(), list(t.key), "left_anti"), some)

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream is in this version; else it is from now on."""
        if self.batches.get(stream, -1) >= batch:
            return True
        self.batches[stream] = batch
        return False

    def commit(self) -> int:
        """Make the next version. Files of a transaction that fails are removed by ``vacuum``."""
        tables = {n: {"key": t.key, "schema": t.schema, "buckets": t.buckets, "within": t.within, "files": t.files} for n, t in self.tables.items()}
        self.store._put(self.version + 1, {"tables": tables, "batches": self.batches})
        return self.version + 1
