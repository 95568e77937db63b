"""A stream of the lines of growing files: of each file, what came since the last batch, up to its last whole line.

The offset of the stream stands for one number a file, how far it was read. Bytes are read once; a line that is not finished
waits. A file that became shorter is another one and is read from its start. Files are opened through Arrow's file systems.

With a folder for its ``state``, an offset of many files is a listing in that folder, which the offset names, and tasks find
their ranges there. So what the driver holds follows the largest folder of files, not all files, and Spark's log of offsets,
its progress reports and its tasks hold a name each. Listings are read and written in order of path, some rows at a time.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, chain, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, session_id string, project string, offset bigint, value string"
#: Bytes of a task, of a read, and of a batch of rows.
TASK, READ = 64 << 20, 4 << 20
#: Ends of files are looked for by so many threads, as this is waiting for a file system.
THREADS = 16
#: Files that an offset holds itself, of a stream with a folder for its state.
HELD = 1_000
#: Files of a task, and rows of a listing that are in memory at once.
FILES, ROWS = 10_000, 4_096
LISTING = pa.schema({"path": pa.string(), "size": pa.int64(), "end": pa.int64()})
RANGES = pa.schema({"path": pa.string(), "begin": pa.int64(), "end": pa.int64()})


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path there. ``file:/x``, as Hadoop writes it, is ``file:///x``."""
    root = re.sub(r"^file:/(?!/)", "file:///", root)
    return pafs.FileSystem.from_uri(root if "://" in root else posixpath.abspath(root))


@dataclass
class Ranges(InputPartition):
    """Bytes of files: (path, from, to), or the name of the file that holds these."""

    value: list[tuple[str, int, int]] | str


def stored(fs: pafs.FileSystem, path: str, rows: Iterable[tuple], schema: pa.Schema) -> None:
    with fs.open_output_stream(path) as f, pa.ipc.new_stream(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for some in batched(rows, ROWS):
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema))


def loaded(fs: pafs.FileSystem, path: str) -> Iterator[tuple]:
    with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as batches:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def place(path: str) -> list[str]:
    """The order of paths in listings: by folder, then name, as ``files`` finds them."""
    return path.split("/")


def files(fs: pafs.FileSystem, folder: str, suffix: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files below a folder, in order of ``place``. In memory is what lies right in a folder."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    kinds = {pafs.FileType.File: 0, pafs.FileType.Directory: 1}
    for path, kind, size in sorted((i.path, kinds[i.type], i.size) for i in found if i.type == pafs.FileType.Directory or i.type == pafs.FileType.File and i.path.endswith(suffix)):
        if kind:
            yield from files(fs, path, suffix)
        else:
            yield path, size


def joined(rows: Iterable[tuple], others: Iterable[tuple], missing: tuple) -> Iterator[tuple]:
    """Rows with what follows their path in ``others``, or ``missing``. Both begin with a path and stand in order of ``place``."""
    others = iter(others)
    other = next(others, None)
    for row in rows:
        while other and place(other[0]) < place(row[0]):
            other = next(others, None)
        yield *row, *(other[1:] if other and other[0] == row[0] else missing)


def last_line_end(fs: pafs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """Where the last whole line ends, or ``least`` if none ends behind it."""
    with fs.open_input_file(path) as f:
        end = size
        while end > least:
            start = max(least, end - (64 << 10))
            found = f.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return least


def whole_lines(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin from ``start`` on and before ``stop``, without line ends."""
    at = start
    if start > 0:  # the line that begins here may have begun before
        f.seek(start - 1)
        at = start - 1
        skip = True
    else:
        f.seek(0)
        skip = False
    held = b""
    while True:
        data = f.read(READ)
        if not data:
            return
        parts = (held + data).split(b"\n")
        held = parts.pop()
        for line in parts:
            if skip:
                skip = False
            elif at >= stop:
                return
            else:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        if at >= stop and not skip:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str, state: str | None = None):
        self.root, self.suffix, self.state = root, suffix, state
        self.seen: list[tuple[str, int, int]] | str = []  # path, size and end of the last whole line, as last seen, or the listing that holds them

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        rows = self._ends()
        held = list(islice(rows, HELD + 1 if self.state else None))
        if not self.state or len(held) <= HELD:
            self.seen = held
            return {path: end for path, _, end in held}
        known, n = hashlib.sha256(), 0

        def counted() -> Iterator[tuple]:
            nonlocal n
            for row in chain(held, rows):
                known.update(f"{row[0]}\0{row[2]}\0".encode())
                n += 1
                yield row

        fs, folder = opened(self.state)
        fs.create_dir(folder)
        new = f"{folder}/{uuid.uuid4().hex}"
        stored(fs, new, counted(), LISTING)
        self.seen = f"listing-{known.hexdigest()}"  # equal offsets have equal names
        if fs.get_file_info(f"{folder}/{self.seen}").type == pafs.FileType.NotFound:
            fs.move(new, f"{folder}/{self.seen}")
        else:
            fs.delete_file(new)
        return {"listing": self.seen, "files": n}

    def _listed(self, name: str) -> Iterator[tuple]:
        fs, folder = opened(self.state)
        return loaded(fs, f"{folder}/{name}")

    def _ends(self) -> Iterator[tuple[str, int, int]]:
        """(path, size, end of the last whole line) of all files. Ends are looked for where the size changed."""
        fs, root = opened(self.root)
        seen = self._listed(self.seen) if isinstance(self.seen, str) else self.seen

        def ended(row: tuple[str, int, int, int]) -> int:
            path, size, before, end = row
            return last_line_end(fs, path, size, end if before < size else 0)

        with ThreadPoolExecutor(THREADS) as pool:
            for some in batched(joined(files(fs, root, self.suffix), seen, (-1, 0)), ROWS):
                changed = pool.map(ended, [row for row in some if row[1] != row[2]])
                for path, size, before, end in some:
                    yield path, size, end if size == before else next(changed)

    def _offsets(self, offset: dict) -> Iterator[tuple[str, int]]:
        if "listing" in offset:
            return ((path, end) for path, _, end in self._listed(offset["listing"]))
        return iter(sorted(offset.items(), key=lambda x: place(x[0])))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, to, begin in joined(self._offsets(end), self._offsets(start), (0,)):
            begin = 0 if to < begin else begin
            while begin < to:
                n = min(to - begin, TASK - size)
                held.append((path, begin, begin + n))
                begin, size = begin + n, size + n
                if size >= TASK or len(held) >= FILES:
                    out.append(self._ranges(held, end))
                    held, size = [], 0
        return [*out, self._ranges(held, end)] if held or not out else out

    def _ranges(self, held: list[tuple[str, int, int]], end: dict) -> Ranges:
        if "listing" not in end:
            return Ranges(held)
        fs, folder = opened(self.state)
        name = f"{end['listing']}-{uuid.uuid4().hex}"
        stored(fs, f"{folder}/{name}", held, RANGES)
        return Ranges(name)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        rows, held = [], 0  # of as many files as a batch holds
        for path, start, stop in self._listed(partition.value) if isinstance(partition.value, str) else partition.value:
            *_, project, name = ("", *path.split("/"))
            own = (path, name.removesuffix(self.suffix), project)
            with fs.open_input_file(path) as f:
                for at, line in whole_lines(f, start, stop):
                    if line.strip():
                        rows.append((*own, at, line.decode(errors="replace")))
                        held += len(line)
                    if held >= READ:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def commit(self, end: dict) -> None:
        """Remove what came before ``end``; the batch behind it is planned by now, from ``end`` to what was last seen."""
        if self.state:
            fs, folder = opened(self.state)
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.base_name != end.get("listing") and not (isinstance(self.seen, str) and info.base_name.startswith(self.seen)):
                    fs.delete_file(info.path)


class TailSource(DataSource):
    """Format ``tail``, with the options path, suffix (``.jsonl``) and state (none)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("state"))


def tail(spark: SparkSession, root: str, suffix: str = ".jsonl", state: str | None = None) -> DataFrame:
    """The lines of files below a folder as a stream: path, session_id (the file's name), project (its folder), offset (of the line's first byte), value.

    ``state`` names a folder, outside ``root`` and for this stream alone, that lasts as long as the stream's checkpoint. Without
    it, offsets hold all files.
    """
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner of a stream need not have this library
    spark.dataSource.register(TailSource)
    options = {"suffix": suffix} | ({"state": state} if state else {})
    return spark.readStream.format("tail").options(**options).load(root)


def transcript_tail(spark: SparkSession, root: str, state: str | None = None) -> DataFrame:
    """Parsed transcript lines as they come: session_id, project, line (the offset of its first byte, which keeps the order), data (variant)."""
    lines = tail(spark, root, state=state).select("session_id", "project", F.col("offset").alias("line"), F.try_parse_json("value").alias("data"))
    return lines.where("data is not null")
