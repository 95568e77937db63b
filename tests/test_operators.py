"""Operators on small rows whose results are known."""

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import extract, fuzzy, history, profile, search, sessions, upsert
from mnemospark.sources import transcripts


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


def test_task_descriptions(spark):
    clean = lambda t: _one(spark, C.clean_task(F.col("t")), t=t)
    assert clean("Hi Claude, please can you fix the parser") == "Fix the parser"
    assert clean("hello! Thanks for your help. Could you add a test for the tokenizer?") == "Add a test for the tokenizer?"
    assert clean("x" * 300) == "X" + "x" * 199 + "..."
    assert clean("   ") == ""


def test_errors_normalised(spark):
    norm = lambda t: _one(spark, C.normalise_error(F.col("t")), t=t)
    assert norm("Error at line 42 in /home/a/b.py") == "Error at line <N> in <FILE>"
    assert norm("bad pointer 0x7fff12 at 2024-01-02T03:04:05Z") == "bad pointer <ADDR> at <TIME>"
    assert norm("x.c:10:20: and y:7") == "x.c:<N>:<N>: and y:<N>"
    kind = lambda t: _one(spark, C.error_type(F.col("t")), t=t)
    assert (kind("TypeError: x"), kind("oops panic: y"), kind("nothing"), kind("error[E0308]: z")) == ("TypeError", "panic", None, "E0308")


def test_languages(spark):
    lang = lambda t: _one(spark, C.detect_language(F.col("t")), t=t)
    assert lang("import os\ndef f(x):\n    return x") == "python"
    assert lang("SELECT a FROM b WHERE c") == "sql"
    assert lang("const x = 1; function f() {}") == "javascript"
    assert lang("plain words") is None


def test_decay_falls_with_age(spark):
    ages = spark.sql("SELECT timestamp '2024-06-01' AS ts UNION ALL SELECT timestamp '2024-03-03' UNION ALL SELECT timestamp '2000-01-01' UNION ALL SELECT NULL UNION ALL SELECT timestamp '2030-01-01'")
    got = {str(r.ts)[:4] if r.ts else None: r.d for r in ages.select("ts", C.decay(F.col("ts"), F.lit("2024-06-01").cast("timestamp")).alias("d")).where("ts is null or ts <> timestamp '2024-03-03'").collect()}
    assert got == {"2024": 1.0, "2000": 0.1, None: 0.5, "2030": 1.0}
    assert _one(spark, C.decay(F.lit("2024-03-03").cast("timestamp"), F.lit("2024-06-01").cast("timestamp"))) == pytest.approx(0.5)


def test_remotes_and_paths(spark):
    for url in ("git@host.org:Me/Repo.git", "https://host.org/Me/Repo", "ssh://git@host.org/Me/Repo.git", "http://host.org/Me/Repo.git"):
        assert _one(spark, C.normalise_remote(F.col("u")), u=url) == "host.org/Me/Repo"
    assert _one(spark, C.decode_project(F.col("u")), u="-a-b") == "/a/b"
    assert (C.like_pattern("m.py"), C.like_pattern("src/*.py"), C.like_pattern("*x")) == ("%m.py", "src/%.py", "%x")


def test_excerpts(spark):
    text = "start " + "filler " * 60 + "needle " + "filler " * 60 + "end"
    got = _one(spark, C.excerpt_around(F.col("t"), F.array(F.lit("needle")), 50), t=text)
    assert got.startswith("...filler") and got.endswith("filler...") and "needle" in got and len(got) <= 2 * 50 + 6 + 6
    assert _one(spark, C.excerpt_around(F.col("t"), F.array(F.lit("absent")), 5), t=text) == text[:10] + "..."
    assert _one(spark, C.excerpt_around(F.col("t"), F.array(F.lit("b c"), F.lit("a")), 3), t="a b c") == "a b..."


def _plain_excerpts(content, query, most=3):
    """The rule of ``columns.excerpts_of`` place by place."""
    out, start = [], 0
    while len(out) < most and (at := content.lower().find(query.lower(), start)) >= 0:
        begin, end = max(0, at - 100), min(len(content), at + len(query) + 100)
        if begin > 0 and (space := content.rfind(" ", begin, at)) > begin:
            begin = space + 1
        out.append(("..." if begin else "") + content[begin:end].strip() + ("..." if end < len(content) else ""))
        start = at + len(query)
    return out


def test_excerpts_of_a_query(spark):
    rng = random.Random(8)
    for _ in range(6):
        text = " ".join(rng.choice(["Alpha", "beta", "x.y", "gamma" * 9, "a+b"]) for _ in range(rng.randint(1, 90)))
        for query in ("beta", "A+B", "x.y alpha", "none"):
            assert _one(spark, C.excerpts_of(F.col("t"), query), t=text) == _plain_excerpts(text, query)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_bounds(a, b):
    assert fuzzy.distance(a, b) == fuzzy.distance(b, a)
    assert (fuzzy.distance(a, b) == 0) == (a == b)
    assert abs(len(a) - len(b)) <= fuzzy.distance(a, b) <= max(len(a), len(b))


def test_edit_distance_transposes():
    assert (fuzzy.distance("teh", "the"), fuzzy.distance("ca", "abc"), fuzzy.distance("kitten", "sitting")) == (1, 2, 3)


def test_corrections_find_all_near_words(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(4, 7))) for _ in range(150)})
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(4, 7))) for _ in range(60)} - set(words))
    v = spark.createDataFrame([(w, i % 5 + 1) for i, w in enumerate(words)], "term string, frequency long")
    got = {r.term: (r.correction, r.edits) for r in fuzzy.closest(spark.createDataFrame([(t,) for t in terms], "term string"), v).collect()}
    want = {}
    for t in terms:
        near = [(fuzzy.distance(t, w), -(i % 5 + 1), w) for i, w in enumerate(words)]
        if min(near)[0] <= 2:
            want[t] = (min(near)[2], min(near)[0])
    assert got == want
    q = spark.createDataFrame([(1, "fnd the databse now")], "id long, text string")
    words = spark.createDataFrame([("database", 3), ("find", 1)], "term string, frequency long")
    assert fuzzy.corrected_queries(q, "id", "text", words).first()["query"] == "fnd the database now"


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple cherry"), (3, "apple apple"), (4, "kiwi"), (5, None)], "id long, text string")
    got = {r.id: r.score for r in search.bm25(docs, "id", F.coalesce("text", F.lit("")), ["banana", "apple"]).collect()}
    assert max(got, key=got.get) == 1 and set(got) == {1, 2, 3}
    assert [r.id for r in search.bm25(docs, "id", F.coalesce("text", F.lit("")), ["banana", "apple"], all_terms=True).collect()] == [1]


def test_merge_has_each_session_once(spark):
    v = spark.createDataFrame([(1, 0.5), (2, 0.4)], "session_id long, score double")
    k = spark.createDataFrame([(2, 9.0), (3, 8.0)], "session_id long, score double")
    assert sorted(map(tuple, search.merge_hybrid(v, k).collect())) == [(1, 0.5, "vector"), (2, 0.4, "vector"), (3, 8.0, "keyword")]


def _plain_chunks(text, most):
    """The rule of ``search.chunks`` chunk by chunk."""
    if len(text) <= 4000:
        return [text]
    if (len(text) - 500) // 3500 + 1 > most:
        step = (len(text) - 4000) / (most - 1)
        return [text[:4000], *(text[int(step * i) : int(step * i) + 4000] for i in range(1, most - 1)), text[-4000:]]
    out = []
    for start in range(0, len(text), 3500)[:most]:
        part = text[start : start + 4000]
        if start + 4000 < len(text) and (line := part[-200:].rfind("\n")) > 0:
            part = part[: len(part) - 200 + line + 1]
        out.append(part)
    return out


@pytest.mark.parametrize("length,most", [(10, 50), (4000, 50), (4001, 50), (7400, 50), (12000, 50), (175300, 50), (240000, 50), (9000, 3), (12000, 3)])
def test_chunks_follow_the_rule(spark, length, most):
    rng = random.Random(length)
    text = "".join(rng.choice("abcdefgh" * 20 + "\n") for i in range(length))
    rows = search.chunks(spark.createDataFrame([(1, text), (2, "")], "id long, text string"), "id", "text", most=most).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in rows] == _plain_chunks(text, most) and {r.id for r in rows} == {1}


@pytest.mark.parametrize("length,most", [(10, 50), (4000, 50), (12000, 50), (240000, 50), (9000, 3)])
def test_chunks_cover_both_ends(spark, length, most):
    text = "".join(chr(97 + i % 26) for i in range(length))
    rows = search.chunks(spark.createDataFrame([(1, text), (2, "")], "id long, text string"), "id", "text", most=most).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and len(rows) <= most and rows[0].chunk_text == text[:4000] and text.endswith(rows[-1].chunk_text)


def test_document_text_skips_what_does_not_fit(spark):
    parts = F.array(F.lit("a" * 10), F.lit("b" * 50), F.lit(None).cast("string"), F.lit("c" * 5))
    assert _one(spark, sessions.document_text(parts, 30)) == "a" * 10 + "\n\n" + "c" * 5


def test_errors_and_solutions(spark):
    rows = [(1, 0, "user", "TypeError: bad thing at line 3"), (1, 1, "assistant", "hm"), (1, 2, "assistant", "The fix is: restart the worker and clear it"), (1, 5, "user", "TypeError: bad thing at line 9"), (2, 0, "user", "ValueError: another one here"), (2, 4, "assistant", "to fix: look at the far away message")]
    m = spark.createDataFrame(rows, "session_id long, msg_idx long, role string, content string")
    found = extract.with_solutions(extract.errors(m), m)
    got = {(r.session_id, r.msg_idx): (r.error_type, r.solution) for r in found.collect()}
    assert got == {(1, 0): ("TypeError", "restart the worker and clear it"), (2, 0): ("ValueError", None)}
    assert {r.occurrence_count for r in extract.error_patterns(found).collect()} == {1}


def test_artifacts(spark):
    text = "Look:\n```python\nimport os\nprint(os.getcwd())\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- one\n- two\n- three\n\n{\"a\": 1, \"b\": {\"c\": 2}}\nhttps://site.org/a/long/path https://site.org/another/path"
    m = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "assistant", text), (1, 2, "system", text)], "session_id long, msg_idx long, role string, content string")
    got = {(r.artifact_type, r.language) for r in extract.artifacts(m).collect()}
    assert got == {("code_block", "python"), ("table", None), ("list", None), ("config", "json"), ("url", None)}


def test_facts_concepts_keywords(spark):
    text = "You must always validate the incoming tokens. Redis is used for caching the sessions. The auth service handles logins of users. Error: timeout in src/app.py"
    m = spark.createDataFrame([(1, 0, "assistant", text)], "session_id long, msg_idx long, role string, content string")
    assert [(r.priority, r.fact) for r in extract.facts(m).collect()] == [(4, "You must always validate the incoming tokens.")]
    assert {(r.type, r.name) for r in extract.concepts(m, F.lit("/p")).collect()} == {("technology", "redis"), ("component", "auth service")}
    assert {"py", "timeout"} <= {r.term for r in extract.keywords(m).collect()}


def test_reconstruction(spark):
    rows = [(1, "write", "f", 1, "a b a", None, None, False), (2, "edit", "f", 2, None, "a", "c", False), (3, "edit", "f", 3, None, "zz", "y", False), (4, "edit", "f", 4, None, "a", "d", True), (5, "edit", "g", 4, None, "a", "d", True)]
    ops = spark.createDataFrame([(e, 1, o, f, t, c, a, b, r) for e, o, f, t, c, a, b, r in rows], "event_id long, session_id long, op string, file_path string, t int, content string, old_string string, new_string string, replace_all boolean")
    ops = ops.withColumn("ts", F.timestamp_seconds("t"))
    r = history.reconstruct(ops).collect()
    assert [(x.file_path, x.content, x.edits_applied, x.edits_failed, x.confidence) for x in r] == [("f", "c b d", 2, 1, round(0.95 * 2 / 3, 4))]
    assert history.reconstruct(ops, F.timestamp_seconds(F.lit(1))).first().content == "a b a"


def test_profile(spark):
    m = spark.createDataFrame([(1, 0, "user", "Hi, my name is Ada."), (1, 1, "user", "I never commit secrets into main branches"), (1, 2, "user", "i never commit secrets into main branches now"), (2, 0, "user", "call me Ada please"), (2, 1, "user", "i'm tired")], "session_id long, msg_idx long, role string, content string")
    scores = profile.name_scores(profile.name_candidates(m)).collect()
    assert [(r.name, r.sessions, r.score) for r in scores] == [("Ada", 2, round(1.8 * 1.5 + math.log(3), 4))]
    rules = profile.learned_rules(profile.rules(m), profile.revocations(m)).collect()
    assert {(r.rule_type, r.frequency) for r in rules} >= {("never", 2)}
    t = spark.createDataFrame([(1, 0, "fix the parser bug"), (1, 1, "fix the parser bugs"), (1, 2, "write documentation")], "session_id long, place long, task string")
    assert sorted((r.task, r.n) for r in profile.distinct_tasks(t).collect()) == [("fix the parser bug", 2), ("write documentation", 1)]


def _plain_rules(rules, ends, least=0.7, revoking=0.5):
    """The fold of ``profile.learned_rules``, statement by statement."""
    kept = []
    for _, kind, text, words, confidence in sorted([(p, k, t, w, c) for p, k, t, w, c in rules] + [(p, None, None, w, None) for p, w in ends], key=lambda e: (e[0], e[1] is None)):
        if kind is None:
            for rule in kept:
                rule["revoked"] |= len(words & rule["words"]) >= revoking * len(rule["words"])
            continue
        best, score = None, 0.0
        for rule in kept:
            if rule["type"] == kind and not rule["revoked"]:
                s = len(words & rule["words"]) / len(words | rule["words"])
                if s > score and s >= least:
                    best, score = rule, s
        if best is None:
            kept.append({"type": kind, "text": text, "words": words, "n": 1, "c": confidence, "revoked": False})
        else:
            best["n"], best["c"] = best["n"] + 1, min(1.0, max(best["c"], confidence) + 0.05)
    return sorted((r["type"], r["text"], r["n"], round(r["c"], 6), r["revoked"]) for r in kept)


@pytest.mark.parametrize("seed", range(3))
def test_rules_fold_as_stated_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["keep modules small", "keep modules small now", "keep all modules small", "review every migration", "review every migration twice", "squash commits early"]
    rules, ends = [], []
    for i in range(60):
        if rng.random() < 0.15:
            ends.append((1, i, 0, sorted(set(rng.choice(pool).split()))))
        else:
            rules.append((1, i, 0, rng.choice(["always", "prefer"]), rng.choice(pool), None, 0.8))
    found = spark.createDataFrame(rules, "session_id long, msg_idx long, at int, rule_type string, rule_text string, scope string, confidence double")
    gone = spark.createDataFrame(ends, "session_id long, msg_idx long, at int, words array<string>")
    got = sorted((r.rule_type, r.rule_text, r.frequency, round(r.confidence, 6), r.revoked) for r in profile.learned_rules(found, gone).collect())
    words = lambda t: {w for w in t.split() if len(w) > 1}
    want = _plain_rules([((s, i, a), k, t, words(t), c) for s, i, a, k, t, _, c in rules], [((s, i, a), set(w)) for s, i, a, w in ends])
    assert got == want
    none = profile.learned_rules(found.where("false"), gone)
    assert none.count() == 0 and profile.learned_rules(found, gone.where("false")).where("revoked").count() == 0


def test_components(spark):
    from mnemospark.operators.graph import components

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_lifecycle_confidence_is_a_running_mean(spark):
    rng = random.Random(1)
    rows = [(i, "lifecycle", "Plan -> Test", round(rng.random(), 2)) for i in range(150)] + [(1, "workflow", "x", 0.5), (2, "workflow", "x", 0.5)]
    got = {r.description: (r.frequency, r.confidence) for r in profile.work_patterns(spark.createDataFrame(rows, "session_id long, pattern_type string, description string, confidence double")).collect()}
    c = rows[0][3]
    for _, _, _, x in rows[1:150]:
        c = min(1.0, (c + x) / 2 + 0.05)
    assert got["Plan -> Test"] == (150, pytest.approx(c)) and got["x"] == (2, 0.5)


def test_tasks_fold_in_order(spark):
    from mnemospark.operators import context

    rng = random.Random(3)
    pool = ["Fix the parser bug", "fix the parser  bugs today", "TODO: write documentation", "Write documentation for the API", "Plan the exporter", "/clear", "<command-x>", ""]
    rows = [(s, i, rng.choice(pool)) for s in range(4) for i in range(12)]
    got = {(r.session_id, r["rank"]): r.task for r in context.recent_tasks(spark.createDataFrame(rows, "session_id long, place long, task_description string"), "session_id").collect()}
    want = {}
    for s in range(4):
        groups = []
        for _, _, t in [r for r in rows if r[0] == s]:
            if not t or t.startswith(("/", "<command-")):
                continue
            norm = " ".join(t.removeprefix("TODO: ").split())[:100].lower()
            for g in groups:
                if norm.startswith(g[0][:35]) or g[0].startswith(norm[:35]) or profile._alike(norm, g[0]) > 0.5:
                    g[1].append(t)
                    break
            else:
                groups.append([norm, [t]])
        want |= {(s, i): min(g[1], key=len) for i, g in enumerate(groups[:5], 1)}
    assert got == want


def test_distances_of_many_pairs():
    rng = random.Random(9)
    for n, m in ((1, 1), (4, 6), (6, 5), (7, 7)):
        words = [("".join(rng.choice("abc") for _ in range(n)), "".join(rng.choice("abc") for _ in range(m))) for _ in range(60)]
        codes = [np.array([[ord(c) for c in w] for w in side]) for side in zip(*words, strict=True)]
        assert fuzzy.distances(*codes).tolist() == [fuzzy.distance(a, b) for a, b in words]


def test_zones_by_any_part_of_the_path(spark):
    files = spark.createDataFrame([("src/my_api.py",), ("src/other.py",), ("API.PY",)], "file_path string")
    zones = spark.createDataFrame([("api.py", 2), ("o", 3), ("", 9)], "path_pattern string, issue_count long")
    got = sorted((r.file_path, r.path_pattern) for r in profile.zones_of_files(files, zones).collect())
    assert got == [("API.PY", "api.py"), ("src/my_api.py", "api.py"), ("src/other.py", "o")]


def test_snapshots_go_from_day_to_day(spark):
    rng = random.Random(5)
    at = lambda: rng.randrange(0, 10 * 86400)
    writes = [(i, 1, "write", f"f{rng.randrange(3)}", at(), f"c{i}") for i in range(40)]
    asked = [(i, f"f{rng.randrange(4)}", at()) for i in range(60)]
    ops = spark.createDataFrame(writes, "event_id long, session_id long, op string, file_path string, t long, content string").withColumn("ts", F.timestamp_seconds("t"))
    targets = spark.createDataFrame(asked, "target_id long, file_path string, t long").select("target_id", "file_path", F.timestamp_seconds("t").alias("target"))
    got = {r.target_id: r.content for r in history.snapshot_as_of(ops, targets).collect()}
    want = {i: max(((t, e, c) for e, _, _, g, t, c in writes if g == f and t <= s), default=(0, 0, None))[2] for i, f, s in asked}
    assert got == want


def test_vector_index_life(spark):
    from mnemospark.operators import vectors

    s = spark.createDataFrame([(1, "a b " * 1500, "short"), (2, "x", ""), (3, "", "")], "session_id long, text string, summary string")
    made = vectors.index(s).cache()
    assert {(r.session_id, r.chunk_index, r.total_chunks) for r in made.collect()} == {(1, 0, 2), (1, 1, 2), (2, 0, 1)}
    assert all(len(r.chunk_text) <= 500 for r in made.collect())
    again = vectors.replace(made, vectors.index(s.where("session_id = 1").withColumn("text", F.lit("new"))))
    assert sorted((r.session_id, r.chunk_text) for r in again.collect()) == [(1, "new"), (2, "x")]
    assert vectors.delete(made, s.where("session_id = 1")).count() == 1 and [r.session_id for r in vectors.not_indexed(s, made).collect()] == [3]
    marked = vectors.mark_indexed(s.withColumn("indexed_at", F.lit(None).cast("timestamp")), made, F.lit("2024-01-01").cast("timestamp"))
    assert marked.where("indexed_at is not null").count() == 2


def test_merges(spark):
    schema = "h string, text string, n long, c double, s array<string>"
    old = spark.createDataFrame([("a", "x", 2, 0.5, ["1", "2"]), ("b", None, 1, 0.9, None)], schema)
    new = spark.createDataFrame([("a", "y", 3, 0.7, ["2", "3"]), ("b", "z", 1, 0.1, ["9"]), ("c", "w", 1, 0.2, [str(i) for i in range(12)])], schema)
    got = {r.h: tuple(r)[1:] for r in upsert.merge(old, new, ["h"], {"text": "first", "n": "sum", "c": "max", "s": "tail"}).collect()}
    assert got == {"a": ("x", 5, 0.7, ["1", "2", "3"]), "b": ("z", 2, 0.9, ["9"]), "c": ("w", 1, 0.2, [str(i) for i in range(2, 12)])}
    life = "description string, frequency long, confidence double"
    both = upsert.lifecycles(spark.createDataFrame([("p", 2, 0.6), ("q", 1, 0.5)], life), spark.createDataFrame([("p", 1, 0.8), ("r", 1, 0.4)], life))
    assert {r.description: (r.frequency, round(r.confidence, 4)) for r in both.collect()} == {"p": (3, 0.75), "q": (1, 0.5), "r": (1, 0.4)}


def test_transcripts_as_a_stream(spark, tmp_path):
    from mnemospark.streaming import queries as streams

    folder = tmp_path / "in" / "-p"
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text('{"type":"user","message":{"content":"x"}}\n{bad\n')
    lines = streams.transcript_stream(spark, str(tmp_path / "in"))
    counts = lambda rows: rows.groupBy("session_id").agg(F.count("*").alias("n"))
    for _ in range(2):  # what was read is not read again
        streams.ingest(lines, str(tmp_path / "state"), {"counts": counts}, str(tmp_path / "out"))
    assert [(r.session_id, r.n) for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()] == [("s1", 1)]
    (folder / "s2.jsonl").write_text('{"type":"user"}\n')
    streams.ingest(lines, str(tmp_path / "state"), {"counts": counts}, str(tmp_path / "out"))
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()) == ["s1", "s2"]


def test_gates(spark):
    from mnemospark.functions import gates as G

    is_ = lambda f, t: _one(spark, f(F.col("t")), t=t)
    assert is_(G.is_decision, "We keep one database per tenant.") and not is_(G.is_decision, "we keep one database") and not is_(G.is_decision, "Let me check whether it is there now.")
    assert is_(G.is_completed, "Parser fixed") and not is_(G.is_completed, "Plan the parser") and is_(G.is_completed, '{"status": "gone"}') and not is_(G.is_completed, '{"status": "pending"}')
    assert is_(G.task_key, "TODO:   Fix\n the X") == "fix the x"
    assert is_(G.topic_words, "The parser, (again) and parser!") == ["parser", "again"]
    assert is_(G.plain_summary, "Task: a | Outcome: b c") == "Outcome: b c" and is_(G.plain_summary, "Task: only this") == "only this"
    assert is_(G.shown_rule, "one two three four five six seven eight nine ten eleven, twelve") == "one two three four five six seven eight nine ten eleven..."
    assert is_(G.scope, "Do it when testing") == "testing" and is_(G.scope, "nothing here") is None
    same = spark.createDataFrame([("Fix the parser bug", "fix the parser bug in src"), ("Write docs", "Plan the exporter")], "a string, b string")
    assert [r.x for r in same.select(G.same_task(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]


def test_upserts(spark):
    schema = "id long, a string, n long"
    old, new = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], schema), spark.createDataFrame([(1, None, 5), (3, "z", 1)], schema)
    assert sorted(map(tuple, upsert.coalesce_merge(old, new, ["id"]).collect())) == [(1, "x", 5), (2, "y", 2), (3, "z", 1)]
    assert sorted(r.id for r in upsert.insert_ignore(old, new.union(new), ["id"]).collect()) == [1, 2, 3]


def test_transcripts(spark, tmp_path):
    folder = tmp_path / "-home-me-proj"
    folder.mkdir()
    lines = [
        '{"type":"user","timestamp":"2025-12-07T14:30:00.123Z","gitBranch":"main","message":{"content":"Hello there"}}', "", "{bad", '{"type":"summary","summary":"first"}', '{"type":"summary","summary":"last"}',
        '{"type":"assistant","timestamp":"2025-12-07T14:31:00Z","message":{"model":"m1","content":[{"type":"text","text":"one"},"two",{"type":"tool_use","name":"Read","input":{"file_path":"a.py"}},{"type":"tool_use","name":"Edit","input":{"file_path":"a.py","old_string":"x","new_string":"y"}},{"type":"tool_use","name":"TodoWrite","input":{"todos":[{"content":"t1","status":"done"},{"content":"t2"}]}}]}}',
        '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Write","input":{"file_path":"b.py","content":"z"}}]}}',
    ]
    (folder / "s1.jsonl").write_text("\n".join(lines))
    (folder / "agent-s2.jsonl").write_text('{"type":"user","message":{"content":"x"}}\n')
    files = {r.session_id: r.is_agent for r in transcripts.discover(spark, str(tmp_path)).collect()}
    assert files == {"s1": False, "agent-s2": True} and transcripts.discover(spark, str(tmp_path / "none")).count() == 0
    assert transcripts.discover(spark, str(tmp_path), "/home/me/proj").count() == 2
    raw = transcripts.raw_lines(spark, str(tmp_path)).where("session_id = 's1'")
    assert [(r.role, r.content) for r in transcripts.messages(raw).orderBy("msg_idx").collect()] == [("user", "Hello there"), ("assistant", "one\ntwo")]
    s = transcripts.sessions(raw).first()
    assert (s.message_count, s.summary, s.first_user_message, s.git_branch, s.models_used, s.project) == (2, "last", "Hello there", "main", ["m1"], "-home-me-proj")
    use = transcripts.tool_usage(raw).first()
    assert use.tools_used == {"Read": 1, "Edit": 1, "TodoWrite": 1, "Write": 1} and use.files_touched == ["a.py", "b.py"]
    assert [(r.task, r.status) for r in transcripts.todos(raw).orderBy("place").collect()] == [("t1", "done"), ("t2", "pending")]
    assert [(r.seq, r.op, r.file_path) for r in transcripts.file_operations(raw).orderBy("seq").collect()] == [(0, "edit", "a.py"), (1, "write", "b.py")]


def test_vector_top_all_answers_every_query(spark):
    """All queries of several blocks, with copies of vectors, a vector without direction and a null one, against brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 14, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, 3, [0.0] * 4), (301, 4, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    queries = df.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r.query_id, r["rank"]): (r.session_id, r.chunk, r.score) for r in search.vector_top_all(df, queries, "label", "vec_id", "embedding", block=7).collect()}
    sound = [(i, s, np.array(x) / np.linalg.norm(x)) for i, s, x in rows if x and any(x)]
    want = {}
    for k, _, q in sound:
        if k % 10 == 0:
            best = {}
            for i, s, x in sound:
                best[s] = min(best.get(s, (9, 0)), (-round(float(x @ q), 9), i))
            for rank, (score, s, i) in enumerate(sorted((a, s, i) for s, (a, i) in best.items())[:10], 1):
                want[k, rank] = (s, i, -score)
    assert len(want) > 250 and got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-8 for k in want)


def test_tasks_of_small_sessions_stream(spark):
    """Sessions are folded as they stream, not in a frame each; null keys are one, structs are places, white space of any kind goes."""
    rows = [(None if i == 7 else i, (i, n), t) for i in range(40) for n, t in enumerate(["Fix the parser bug ", "write documentation", "fix the parser bug now please"])]
    out = profile.distinct_tasks(spark.createDataFrame(rows, "session_id long, place struct<a:long,b:int>, task string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert {(r.session_id, r.task.strip(), r.n, r.place.b) for r in out.collect()} == {(None if i == 7 else i, t, n, b) for i in range(40) for t, n, b in [("Fix the parser bug", 2, 0), ("write documentation", 1, 1)]}
