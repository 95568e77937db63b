"""Streams of growing files."""

import io
import json
import pickle
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import tail as tails
from mnemospark.sources.store import Store
from mnemospark.streaming import queries as streams


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_ranges_part_a_file_into_its_lines(monkeypatch, read):
    monkeypatch.setattr(tails, "READ", read)
    rng = random.Random(read)
    for _ in range(100):
        text = "".join(rng.choice(["a", "bb", "\n", "\r\n", "é"]) for _ in range(rng.randint(0, 30))).encode()
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(3))})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in tails.whole_lines(io.BytesIO(text), a, b)]
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        assert got == want


def test_tasks_are_bounded(monkeypatch):
    monkeypatch.setattr(tails, "TASK", 10)
    parts = tails.TailReader("x", ".jsonl").partitions({"a": 5, "gone": 3, "short": 9}, {"a": 28, "b": 4, "c": 3, "same": 0, "short": 2})
    assert [p.value for p in parts] == [[("a", 5, 15)], [("a", 15, 25)], [("a", 25, 28), ("b", 0, 4), ("c", 0, 3)], [("short", 0, 2)]]


def test_every_line_once_and_new_bytes_only(spark, tmp_path):
    """Half a line, then the rest, twice; files that are new, replaced by shorter ones, or no transcripts."""
    folder = tmp_path / "in" / "-p"
    folder.mkdir(parents=True)
    store = Store(spark, str(tmp_path / "s"))

    def run() -> list[tuple]:
        before = store.snapshot().read("lines").count() if store.versions() else 0
        lines = tails.tail(spark, str(tmp_path / "in")).select("session_id", "project", "offset", "value")
        streams.ingest(lines, str(tmp_path / "state"), {"lines": (["session_id", "offset"], lambda b: b, lambda old, new: old.union(new))}, store, "tail")
        rows = [(r.session_id, r.offset, r.value) for r in store.snapshot().read("lines").orderBy("session_id", "offset").collect()] if store.versions() else []
        return [len(rows) - before, rows]

    def add(name: str, text: str) -> None:
        with (folder / name).open("a") as f:
            f.write(text)

    add("s1.jsonl", '{"a":1}\n{"a"')
    add("other.txt", "x\n")
    assert run() == [1, [("s1", 0, '{"a":1}')]]
    assert run()[0] == 0
    add("s1.jsonl", ':2}\n\n{"a":')
    assert run() == [1, [("s1", 0, '{"a":1}'), ("s1", 8, '{"a":2}')]]
    add("s1.jsonl", '3}\nbad\n')
    add("s2.jsonl", '{"b":1}\n')
    assert run() == [3, [("s1", 0, '{"a":1}'), ("s1", 8, '{"a":2}'), ("s1", 17, '{"a":3}'), ("s1", 25, "bad"), ("s2", 0, '{"b":1}')]]
    (folder / "s1.jsonl").write_text("z\n")  # another file of that name
    assert ("s1", 0, "z") in run()[1]
    assert {r.project for r in store.snapshot().read("lines").select("project").collect()} == {"-p"}


def test_new_bytes_only(tmp_path):
    """A batch's tasks read from where the one before ended."""
    (tmp_path / "a.jsonl").write_text("1\n2\n3")
    reader = tails.TailReader(str(tmp_path), ".jsonl")
    first = reader.latestOffset()
    with (tmp_path / "a.jsonl").open("a") as f:
        f.write("4\n5\n")
    second = reader.latestOffset()
    (path,) = second
    assert (first[path], second[path]) == (4, 9)
    (part,) = reader.partitions(first, second)
    assert part.value == [(path, 4, 9)]
    assert [v for b in reader.read(part) for v in b.column("value").to_pylist()] == ["34", "5"]


def test_parsed_lines(spark, tmp_path):
    (tmp_path / "-q").mkdir()
    (tmp_path / "-q" / "s.jsonl").write_text('{"type":"user","message":{"content":"x"}}\n{bad\n[1]\n')
    lines = tails.transcript_tail(spark, str(tmp_path))
    got = streams.run_available(lines.select("session_id", "project", "line", F.to_json("data").alias("j")), streams.folder(spark))
    assert sorted((r.session_id, r.project, r.line, r.j) for r in got.collect()) == [("s", "-q", 0, '{"message":{"content":"x"},"type":"user"}'), ("s", "-q", 47, "[1]")]


def test_small_files_share_batches(tmp_path):
    """A task's files come in batches of a size in bytes, not one or more each."""
    for i in range(50):
        (tmp_path / f"s{i:02}.jsonl").write_text("".join(f"{i}:{k}\n" for k in range(i % 3)) + "half")
    reader = tails.TailReader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    assert len(end) == 50 and reader.latestOffset() == end
    (part,) = reader.partitions({}, end)
    (batch,) = reader.read(part)
    want = [(f"s{i:02}", 5 * k if i > 9 else 4 * k, f"{i}:{k}") for i in range(50) for k in range(i % 3)]
    assert list(zip(*(batch.column(c).to_pylist() for c in ("session_id", "offset", "value")), strict=True)) == want


@pytest.mark.parametrize("n", [20, 400])
def test_many_files_are_a_name_to_the_driver(monkeypatch, tmp_path, n):
    """Offsets and tasks are as long for many files as for some."""
    for name, value in (("HELD", 10), ("FILES", 25), ("ROWS", 7)):
        monkeypatch.setattr(tails, name, value)
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"s{i:03}.jsonl").write_text(f"{i}\nhalf")
    reader = tails.TailReader(str(tmp_path / "in"), ".jsonl", str(tmp_path / "state"))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(json.dumps(end)) < 120 and all(len(pickle.dumps(p)) < 300 for p in parts)
    assert len(parts) == (n + 24) // 25
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == [str(i) for i in range(n)]


def test_listed_offsets_are_as_held_ones(monkeypatch, tmp_path):
    """Files that come, grow, shrink and go, readers that start anew: ranges are those of offsets that hold all files."""
    for name, value in (("HELD", 4), ("ROWS", 3), ("TASK", 20)):
        monkeypatch.setattr(tails, name, value)
    rng, root, state = random.Random(1), tmp_path / "in", str(tmp_path / "state")
    names = [f"{folder}{x}.jsonl" for folder in ("", "a/", "a-b/", "a/c/", "z/") for x in ("a", "a-b", "b", "é")]
    plain = tails.TailReader(str(root), ".jsonl")
    listed = tails.TailReader(str(root), ".jsonl", state)
    start, listed_start, kinds = {}, {}, set()
    for i in range(60):
        for name in rng.sample(names, 1 if i < 8 else 6):
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            if path.exists() and rng.random() < 0.2:
                path.unlink() if rng.random() < 0.5 else path.write_text("n\n")
            else:
                with path.open("a") as f:
                    f.write("".join(rng.choice(["a", "b\n", "\n"]) for _ in range(rng.randint(0, 20))))
        if rng.random() < 0.3:
            listed = tails.TailReader(str(root), ".jsonl", state)
        end, listed_end = plain.latestOffset(), listed.latestOffset()
        if start:
            listed.commit(listed_start)
        kinds.add("listing" in listed_end)
        assert dict(listed._offsets(listed_end)) == end
        ranges = [p.value for p in plain.partitions(start, end)]
        tasks = listed.partitions(listed_start, listed_end)
        assert [list(listed._listed(p.value)) if isinstance(p.value, str) else p.value for p in tasks] == ranges
        assert listed.latestOffset() == listed_end == tails.TailReader(str(root), ".jsonl", state).latestOffset()
        assert [b.to_pylist() for p in tasks for b in listed.read(p)] == [b.to_pylist() for p in plain.partitions(start, end) for b in plain.read(p)]
        start, listed_start = end, listed_end
        assert len(list((tmp_path / "state").glob("listing-" + "?" * 64))) <= 3
    assert kinds == {True, False}


def test_stream_of_many_files_logs_names(spark, monkeypatch, tmp_path):
    """Spark's log of offsets and its progress do not grow with the files; every line comes once; a run without news is no batch."""
    monkeypatch.setattr(tails, "HELD", 3)
    store, folder = Store(spark, str(tmp_path / "s")), tmp_path / "in" / "-p"
    folder.mkdir(parents=True)
    for run, text in enumerate(['{"a":1}\n{"a"', ":2}\n", "", "3\n"]):
        for i in range(40):
            with (folder / f"s{i}.jsonl").open("a") as f:
                f.write(text)
        lines = tails.tail(spark, str(tmp_path / "in"), state=str(tmp_path / "offsets")).select("session_id", "offset", "value")
        streams.ingest(lines, str(tmp_path / "state"), {"lines": (["session_id", "offset"], lambda b: b, lambda old, new: old.union(new))}, store, "tail")
        assert len(store.versions()) == (1, 2, 2, 3)[run]
    got = {(r.session_id, r.offset, r.value) for r in store.snapshot().read("lines").collect()}
    assert got == {(f"s{i}", at, value) for i in range(40) for at, value in ((0, '{"a":1}'), (8, '{"a":2}'), (16, "3"))}
    assert store.snapshot().read("lines").count() == 120
    logs = [p for p in (tmp_path / "state" / "offsets").iterdir() if p.name.isdigit()]
    assert len(logs) == 3 and all("listing" in p.read_text() and len(p.read_text()) < 3000 for p in logs)
    assert len([p for p in (tmp_path / "offsets").iterdir() if len(p.name) == len("listing-") + 64]) == 2
