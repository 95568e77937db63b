"""Exact, substring, near and embedding dedup against brute force, with awkward rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from mnemospark.llm import embedding_dedup, exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, rid long, kept string"


def _corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(rng.randint(1, 120))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    rows += [(200 + i, prose(30) + " " + shared + " " + prose(20)) for i in range(6)]
    base = prose(150).split()
    for i in range(8):
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((300 + i, " ".join(copy)))
    rows += [(400, None), (401, ""), (402, "   \n\t"), (403, "one two"), (404, "ONE  two"), (405, "x" * 3000), (406, "ab" * 2000), (407, prose(9000)), (408, "été " * 90), (409, "a\0b" * 200)]
    rng.shuffle(rows)
    return rows


ROWS = _corpus()


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], DOCS)


def _components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4096, 8])
def test_exact_dedup(spark, block):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(_frame(spark, ROWS), block_bytes=block).collect()}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    assert exact_dedup.exact_dedup(_frame(spark, [])).count() == 0
    rows = exact_dedup.exact_dedup(_frame(spark, [(None, "a"), (None, "a"), (1, "a"), (2, "b"), (2, "b"), (None, None)])).collect()
    assert sum(r.kept for r in rows) == 3 and {r.keep_id for r in rows} == {1, 2, None}
    kept = exact_dedup.keep_one(_frame(spark, [(2, "b"), (2, "b"), (3, "b"), (3, "b"), (1, "c")])).collect()
    assert sorted((r.doc_id, r.text, r.rid, r.kept) for r in kept) == [(1, "c", 7, "clash"), (3, "b", 7, "clash")]


def test_keep_one_with_columns_of_any_kind(spark):
    """Maps can't be compared, and names may clash with those used inside."""
    from pyspark.sql import functions as F

    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "_key", "KEY", "rows", "found_sha", "text_sha")}).withColumn("m", F.create_map(F.lit("k"), F.rand()))
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns and sorted((str(r.doc_id), r.text, r.KEY) for r in got.collect()) == [("2", "a", "KEY"), ("3", "", "KEY"), ("None", "b", "KEY")]


def test_exact_dedup_shared_hashes(spark, monkeypatch):
    """Distinct blocks under one hash are told apart by their contents."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 3)
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(_frame(spark, ROWS), block_bytes=64).collect()}
    last = {t or "": max(i for i, u in ROWS if (u or "") == (t or "")) for _, t in ROWS}
    assert got == {i: last[t or ""] for i, t in ROWS}


def _brute_spans(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            else:
                seen[w] = i
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1 << 19)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_spans(_frame(spark, ROWS), hot=hot).collect()}
    assert got == _brute_spans(ROWS)
    assert sum(r[1] for r in got.values()) > 3000


@pytest.mark.parametrize("local", [1, 50, 10**6])
def test_substring_dedup_with_repeats_inside_tasks(spark, local, monkeypatch):
    """Anchors that repeat inside a task's own lot are settled there, whatever its size."""
    monkeypatch.setattr(substring_dedup, "LOCAL", local)
    rows = [(i, t) for i, t in ROWS if i < 320]
    anchors = list(substring_dedup._anchor_rows(iter([substring_dedup.pa.RecordBatch.from_pydict({"doc_id": [1, 2], "dk": [5, 6], "bytes": [b"abcdefgh" * 5 + bytes(range(100))] * 2}, schema=substring_dedup.pa.schema([("doc_id", "int64"), ("dk", "int64"), ("bytes", "binary")]))])))
    assert sum(b.column("key").null_count for b in anchors) == (0 if local == 1 else sum(b.num_rows for b in anchors) // 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_spans(_frame(spark, rows)).collect()}
    assert got == _brute_spans(rows)


def test_substring_dedup_odd_rows(spark):
    assert substring_dedup.repeated_spans(_frame(spark, [])).count() == 0
    text = "0123456789" * 5 + "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest at night"
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in substring_dedup.repeated_spans(_frame(spark, [(None, text), (1, text), (1, text), (None, None)])).collect())
    assert got == [(False, 0, 0), (False, 0, 0), (True, 1, len(text)), (True, 1, len(text))]


def test_anchors_in_segments(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    hasher = substring_dedup.Hasher()
    whole = set(zip(*(x.tolist() for x in substring_dedup.anchors(data, hasher)), strict=True))
    monkeypatch.setattr(substring_dedup, "SEGMENT", 300)
    assert set(zip(*(x.tolist() for x in substring_dedup.anchors(data, hasher)), strict=True)) == whole


def test_deep_shallow_sort():
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(400)] + [b"a" * 50 + bytes([i]) for i in range(40)] + [b"a\0", b"a", b"a\0\0", b""]
    strings += [b"ab" * 30] * 3
    table, lengths = substring_dedup._table(strings, 64)
    order, common = substring_dedup.deep_shallow_sort(table, lengths)
    listed = [strings[i] for i in order]
    assert listed == sorted(strings, key=lambda s: (s.ljust(64, b"\0"), len(s)))
    for i in range(1, len(listed)):
        a, b = listed[i - 1], listed[i]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[i] == n


def _brute_near(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in _components(ids, links).items()}


@pytest.mark.parametrize("words,block", [(4, 256), (5, 3)])
def test_near_dedup(spark, words, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(_frame(spark, ROWS), words=words, block=block).collect()}
    assert got == _brute_near(ROWS, words)


def test_near_dedup_odd_rows(spark):
    assert near_dedup.near_dedup(_frame(spark, [])).count() == 0
    rows = near_dedup.near_dedup(_frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, ""), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("5", "5", True)] * 2 + [("6", "6", True), ("7", "7", True), ("None", "5", False), ("None", "None", True)]
    kept = near_dedup.keep_representatives(_frame(spark, ROWS)).collect()
    assert len(kept) == sum(i == c for i, (_, c) in _brute_near(ROWS, 5).items()) and kept[0].kept == "clash"


def test_near_dedup_tells_words_apart_that_fool_polynomials(spark):
    """Thue-Morse words of 1024 letters and their complements have one hash under any polynomial modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = near_dedup.near_dedup(_frame(spark, [(1, word), (2, other), (3, word)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (3, 1)]


def test_shingles_named_by_the_words_themselves():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    sets = near_dedup.named_shingles(texts, 3)
    plain = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()) for w in (t.split() for t in texts)]
    for i in range(60):
        assert len(sets[i]) == len(plain[i])
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_forest_spans_what_agrees():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, 192)).astype(np.uint8)
    rows = np.concatenate([base[rng.integers(0, 6, 40)], rng.integers(0, 256, (10, 192)).astype(np.uint8)])
    rows[rng.random(rows.shape) < 0.15] = 0
    for side in (None, rng.integers(0, 2, len(rows))):
        agree = (rows[:, None] == rows[None]).sum(2) >= near_dedup.AGREE
        pairs = [(i, j) for i in range(50) for j in range(i) if agree[i, j] and (side is None or side[i] != side[j])]
        got = near_dedup.forest(rows, side)
        assert _components(range(50), got) == _components(range(50), pairs) and len(got) == 50 - len(set(_components(range(50), pairs).values()))


@pytest.mark.parametrize("bucket", [3, 2048])
def test_near_dedup_in_blocks_of_buckets(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "SHINGLES", 500)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(_frame(spark, ROWS), words=4).collect()}
    assert got == _brute_near(ROWS, 4)


def test_recall_on_the_given_tables(spark):
    """Links of ids divisible by 100 with all other rows, by brute force, are all found."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, words=4).collect()}
    sets = {r.doc_id: frozenset(near_dedup.shingles(r.text, 4).tolist()) for r in docs.collect()}
    links = [(a, b) for a in sets if a % 100 == 0 and sets[a] for b in sets if a != b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])]
    assert links and all(found[a] == found[b] for a, b in links)
    v = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    count = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    want = {r.vec_id: int((x @ x[i] >= 0.95).sum()) - 1 for i, r in enumerate(v) if r.vec_id % 100 == 0}
    assert sum(count[i] for i in want) >= 0.998 * sum(want.values()) and all(count[i] <= n for i, n in want.items())


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[300:])
    s = near_dedup.sketches([a, b, pool[:1], pool[:40]], 192)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def _vectors():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(6):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.12).tolist()))
    rows += [(500 + i, rows[0][1]) for i in range(5)] + [(600, [x * 3 for x in rows[0][1]])]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0] * 15 + [None]), (704, []), (705, [1e200] * 16), (706, [1e-200] * 16), (707, [1.0] * 8), (708, [2.0] * 8), (709, [float("inf")] * 16)]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_embedding_dedup(spark, block):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cid int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df, block=block).collect()}
    sound = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and cos(sound[a], sound[b]) >= 0.95]
    parts = _components([i for i, _ in rows], links)
    assert got == {i: (sum(i in p for p in links), parts[i], parts[i] == i) for i, _ in rows}
    assert len(links) > 40


def test_embedding_dedup_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.link_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("3", 2, 3, True)] * 2 + [("None", 2, 3, False)]
