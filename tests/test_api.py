"""The tools over the derived transcript view."""

import pytest
from pyspark.sql import functions as F

from mnemospark.api import Memory
from mnemospark.sources.tables import messages, operations


@pytest.fixture(scope="module")
def memory(spark, sf_dir):
    m = messages(spark, sf_dir).cache()
    projects = m.select("session_id").distinct().withColumn("project_path", F.concat(F.lit("/p"), (F.col("session_id") % 3).cast("string")))
    return Memory(m, operations(spark, sf_dir), projects=projects, as_of=F.lit("2024-02-01").cast("timestamp"))


def test_search_corrects_typos(memory):
    found = memory.search("restrat worker", limit=3)
    assert found["total"] == 3 and found["corrections"]["restrat"] == "restart" and all("worker" in r["excerpt"] for r in found["results"])
    assert memory.search("")["total"] == 0
    whole = memory.search("restart", project_path="/p1", days=60, compact=False)
    assert whole["results"][0]["project_path"] == "/p1" and whole["results"][0]["excerpts"]


def test_search_tiers(memory, spark):
    assert memory.search("branches", limit=2)["search_type"] in ("hybrid", "messages")
    none = memory.search("zzqqxy", limit=2)
    assert none["total"] == 0 and none["suggestions"] and none["unknown_terms"] == ["zzqqxy"]
    some = memory.search("worker OR zzqqxy", limit=2)
    assert some["total"] == 2
    text = memory.messages.groupBy("session_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("content"))).alias("text"), F.max("ts").alias("updated_at"))
    with_archive = Memory(memory.messages, projects=memory.projects, archives=text, as_of=memory.as_of)
    found = with_archive.search("the fix is: restart", limit=3)
    assert found["search_type"] in ("archive", "combined") and "The fix is: restart" in found["results"][0]["excerpt"]
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.0, 1.0])], "session_id long, chunk long, embedding array<float>")
    near = Memory(memory.messages, vectors=vectors, as_of=memory.as_of).search("", query_vector=[1.0, 0.0], limit=2, compact=False, recency_bias=False)
    assert [r["session_id"] for r in near["results"]] == [1, 2] and near["search_type"] == "hybrid"


def test_other_tools(memory):
    assert memory.recent(4)["total"] == 4
    errors = memory.error_lookup("bad value", limit=2)["solutions"]
    assert len(errors) == 2 and all(e["error_type"] == "TypeError" for e in errors)
    assert memory.error_lookup("qqqq")["suggestions"]
    assert memory.decisions(category="general", limit=3)["total"] == 3
    assert memory.decisions("ring", limit=3)["total"] <= 3
    assert memory.code_history("m1.py", mode="snapshot")["results"][0]["file_path"] == "src/m1.py"
    assert len(memory.code_history("m1.py", limit=2)["results"]) == 2 and memory.code_history("m1.py", mode="changes", limit=1)["results"]
    assert "error" in memory.code_history() and "error" in memory.code_history("x", mode="other")
    status = memory.status()
    assert status["progress"]["total"] > 0 and status["errors"]["total"] > 0 and status["decisions"]["total"] > 0


def test_init_and_report(spark, sf_dir):
    from mnemospark.api import report
    from mnemospark.sources.tables import said

    m = said(spark, sf_dir).cache()
    projects = m.select("session_id").distinct().withColumn("project_path", F.concat(F.lit("/p"), (F.col("session_id") % 2).cast("string")))
    start = Memory(m, operations(spark, sf_dir), projects=projects, as_of=F.lit("2024-02-01").cast("timestamp")).init("/p1", ["docker", "wsl2", "codespaces", "linux", "kubernetes", "podman"])
    who = start["profile"]
    assert who["name"] in {"Alice", "Bruno", "Carla", "Dmitri", "Elena"} and who["rules"]["always"] and who["preferences"] and who["tips"]
    assert start["current_work"]["recent_tasks"] and start["recent_decisions"] and "redis" in start["technologies"]
    assert 0 < len(start["guidance"]["actions"]) <= 8 and len({a[:50].lower() for a in start["guidance"]["actions"]}) == len(start["guidance"]["actions"])
    assert {a["type"] for a in start["alerts"]} >= {"danger_zone", "prerequisite"} and start["token_estimate"]["tokens"] > 0
    assert who["name"] in report(start) and "Decisions:" in report(start)


def test_tools_over_transcripts(spark, tmp_path):
    """Two sessions whose operations have the same numbers, from files to answers, also from the command line."""
    import json

    def line(kind, content, at):
        return json.dumps({"type": kind, "timestamp": f"2025-01-02T10:{at:02d}:00Z", "message": {"content": content}})

    def use(name, **given):
        return {"type": "tool_use", "name": name, "input": given}

    folder = tmp_path / "-home-me-proj"
    folder.mkdir()
    one = [line("user", "my name is Ada, fix the parser", 0), line("assistant", [{"type": "text", "text": "The parser is fixed and working well now."}, use("Write", file_path="a.py", content="def f():\n    x = 1")], 1)]
    two = [line("user", "ValueError: cannot parse field 7", 2), line("assistant", "The solution was: skip empty lines before parsing", 3), line("assistant", [use("Edit", file_path="a.py", old_string="x = 1", new_string="x = 2"), use("Edit", file_path="a.py", old_string="x = 2", new_string="x = 3")], 4)]
    (folder / "s1.jsonl").write_text("\n".join(one))
    (folder / "s2.jsonl").write_text("\n".join(two))
    memory = Memory.from_transcripts(spark, str(tmp_path), as_of=F.lit("2025-02-01").cast("timestamp"))
    assert memory.search("parser")["results"][0]["summary"] == "The parser is fixed and working well now"
    assert memory.code_history("a.py", mode="snapshot")["results"][0]["content"] == "def f():\n    x = 3"
    assert [(r["op"], r["line_count"]) for r in memory.code_history("a.py")["results"]] == [("edit", None), ("edit", None), ("write", 2)]
    assert [r["symbol_name"] for r in memory.code_history(symbol="f")["results"]] == ["f"]
    assert memory.error_lookup("parse")["solutions"][0]["solution_summary"] == "skip empty lines before parsing"

    from mnemospark.__main__ import main

    assert main([str(tmp_path), "recent", "limit=1"]) == 0 and main(["x", "unknown"]) == 2
