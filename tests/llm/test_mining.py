"""Phrases, conversation tries and quality rules against SQL and brute force, with awkward rows."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import phrases, quality, trie
from mnemospark.llm.queries import ORACLES, QUERIES


def by_sql(name: str, **tables):
    con = duckdb.connect()
    for table, value in tables.items():
        if isinstance(value, str):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{value}'")
        else:
            con.register(table, value)
    return con.sql(ORACLES[name]).df()


def equal(got, want, key: list[str]) -> None:
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize(("name", "key", "table"), [("op11_phrases", ["lang", "rank"], "documents"), ("op12_prefix_trie", ["conv_id", "depth"], "conversations"), ("op13_quality_rules", ["doc_id"], "documents")])
def test_queries_agree_with_sql(spark, name, key, table):
    sf = "/root/testdata/sf0.01"
    equal(QUERIES[name](spark, sf).toPandas(), by_sql(name, **{table: f"{sf}/{table}.parquet"}), key)


def counted(rows: list[tuple], least: int) -> dict:
    import re

    found = Counter()
    for text, lang in rows:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        found[lang or "und", " ".join(w[i : i + m]), m] += 1
    return {k: n for k, n in found.items() if n >= least}


@pytest.mark.parametrize("rows_a_range", [3, 10_000])
def test_phrase_counts(spark, monkeypatch, rows_a_range):
    """Small ranges and small pieces of text change nothing; null texts and languages, repeated rows and odd white space."""
    monkeypatch.setattr(phrases, "CHUNK", 40)
    rng = random.Random(5)
    rows = [("".join(rng.choice(["a ", "B ", "é x ", "c. ", "d\t", "a b ", "\n", "\x0b", ""]) for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None])) for _ in range(40)] + [(None, "x"), ("", None), ("A b " * 50, "x"), ("A b " * 50, "x")]
    got, totals = phrases.frequent_phrases(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=4, rows=rows_a_range)
    assert {(r.lang, r.phrase, r.words): r.f for r in got.collect()} == counted(rows, 4)
    assert sum(r.n for r in totals.collect()) == sum(n for (_, _, m), n in counted(rows, 1).items() if m == 1)
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_long_text_in_parts():
    """Every suffix of a long text begins in one part, wherever it is cut."""
    rng = random.Random(2)
    for stops in ("", ".;"):
        text = "".join(rng.choice("ab  c" + stops) for _ in range(3000)).encode()
        found = Counter()
        for part, rest in phrases._pieces(text, 50, 5):
            w = phrases.Words([part], ["x"], [rest])
            names = [bytes(x) for x in w.words.to_pylist()]
            for i in np.flatnonzero(w.owned).tolist():
                words = [names[w.ids[i]]]
                while len(words) < 5 and w.next[i + len(words) - 1]:
                    words.append(names[w.ids[i + len(words)]])
                found[tuple(words)] += 1
        want = Counter()
        for piece in text.replace(b";", b".").split(b"."):
            w = piece.split()
            want.update(tuple(w[i : i + 5]) for i in range(len(w)))
        assert found == want


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 4, (500, 5))
    for row, size in enumerate(rng.integers(1, 6, 500)):
        table[row, size:] = -1
    weight = rng.integers(1, 9, 500)
    want = Counter()
    for row, w in zip(table.tolist(), weight.tolist(), strict=True):
        for m in range(1, 6):
            if row[m - 1] >= 0:
                want[tuple(row[:m])] += w
    got = {tuple(table[row, :m].tolist()): n for row, m, n in phrases.multikey_quicksort(table, weight, 40)}
    assert got == {k: n for k, n in want.items() if n >= 40}


@pytest.mark.parametrize("band", [2, 1024])
def test_trie_of_odd_rows(spark, band):
    """Null and equal turns, null roles and texts, ids that pass a double's precision, deep shards and a heavy top."""
    rng = random.Random(band)
    rows = [(c * rng.choice([1, 3]), rng.choice([None, *range(30)]), rng.choice(["user", "u", None]), rng.choice(["a b", None, "c"])) for c in range(60) for _ in range(rng.choice([0, 1, 2, 5, 30]))]
    rows += [(2**60 + 1, 0, "user", "q"), (2**60 + 2, 0, "user", "q"), (2**60 + 2, 0, "user", "q"), (None, 0, "user", "a b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = F.col("conv_id")
    got = trie.conversation_trie(df.withColumn("depth", F.lit("x")), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, least=4, share=1000, band=band).toPandas()
    want = by_sql("op12_prefix_trie", conversations=df.toArrow())
    equal(got, want, ["conv_id", "depth"])
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_trie_without_heads(spark):
    """Plain conversations, two of them equal and one a part of another."""
    rows = [(c, i, "u", t) for c, said in ((3, "abc"), (7, "abc"), (5, "ab"), (9, "x")) for i, t in enumerate(said)]
    got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for k, r in got.items()} == {(3, 0): (4, 2, 2, 5), (3, 1): (3, 1, 1, 5), (3, 2): (3, 1, 1, 3), (3, 3): (2, 0, 1, 1), (9, 1): (1, 0, 1, 0)}


def test_messages_spill():
    """A queue that spills gives the same sums."""
    rng = random.Random(1)
    small, large = trie.Messages(5), trie.Messages(1000)
    for _ in range(200):
        m = (-rng.randint(0, 9), rng.randint(0, 5), 1, rng.randint(0, 3), rng.randint(0, 9))
        small.push(m)
        large.push(m)
    keys = sorted({(-d, o) for d in range(10) for o in range(6)})
    assert [small.taken(k) for k in keys] == [large.taken(k) for k in keys]


def brute(text: str, least: int) -> tuple:
    w, lines = text.encode().split(), text.encode().split(b"\n")
    n, longest, repeats = len(w), 0, set()

    def covered(k):
        windows = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if windows[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                if not (j and w[i - 1] == w[j - 1]):
                    repeats.add(tuple(w[i : i + k]))
    seen = [x for x in lines if x.split()]
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(covered(3)), sum(len(w[i].decode()) for i in covered(least)), longest, len(repeats)


@pytest.mark.parametrize("least", [3, 5])
def test_repetition_by_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = ["".join(rng.choice(["a ", "b ", "é\n", "c# ", "a\n", " ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(8)] + ["", " \n", "x " * 40]
        m = quality.measured([t.encode() for t in texts] + [None], least)
        for k, text in enumerate([*texts, ""]):
            assert tuple(int(m[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat", "n_repeats")) == brute(text, least)


def test_quality_rules_and_spans(spark):
    """A clean text stays, one that says a passage twice goes, and its spans are the bytes of that passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(6))
    clean, passage = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(120))
    rows = [(1, clean, "x"), (2, f"{clean} {passage}\n{passage}", "x"), (3, None, "x"), (4, "", "x"), (1, clean, "x"), (5, "lorem " * 2_000_000, "x")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert [(r.doc_id, r.kept, r.base_failed) for r in got] == [(1, True, False), (2, False, False), (3, False, True), (4, False, True), (1, True, False), (5, False, True)]
    spans = got[1].spans
    assert rows[1][1].encode()[spans[0] : spans[1]].decode() == f"{passage}\n{passage}" and got[1].longest_repeat == 120 and got[1].n_repeats == 1
    assert got[5].longest_repeat == 1_999_999 and got[2].spans == []
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
