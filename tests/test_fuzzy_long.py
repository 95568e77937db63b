"""Typo correction of long words, escaped path patterns, words that are no names."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import fuzzy, profile


def changed(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word) - 1)
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i:], word[:i] + rng.choice("abc") + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])
    return word


def test_distance_within_agrees():
    rng = random.Random(1)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        b = changed(rng, a, rng.randint(0, 3)) if len(a) > 3 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        for most in (0, 1, 2):
            assert fuzzy.distance_within(a, b, most) == min(most + 1, fuzzy.distance(a, b)), (a, b, most)


def test_candidates_of_long_words_are_whole(spark):
    """Every pair within two edits is met, around the length where segments take over."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(9, 26))) for _ in range(150)})
    terms = sorted({changed(rng, rng.choice(words), rng.randint(1, 2)) for _ in range(150)} - set(words))
    w = spark.createDataFrame([(x, 1) for x in words], "term string, frequency long")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    met = {(r.term, r.word) for r in fuzzy._pairs(t, w, 2).collect()}
    near = {(a, b) for a in terms for b in words if abs(len(a) - len(b)) <= 2 and fuzzy.distance(a, b) <= 2}
    assert near and near <= met
    got = {r.term: (r.edits, r.correction) for r in fuzzy.closest(t, w).collect()}
    assert got == {a: min((fuzzy.distance(a, b), b) for x, b in near if x == a) for a in {x for x, _ in near}}


def test_words_of_ten_thousand_letters(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh") for _ in range(10_000)) for _ in range(4)]
    far = long[0][:5000] + "xyz" + long[0][5003:]
    terms = [long[0][:10] + long[0][11:9000] + "z" + long[0][9000:], long[1][:5000] + "z" + long[1][5001:], far]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {r.term: r.correction for r in fuzzy.closest(t, spark.createDataFrame([(x, 1) for x in long], "term string, frequency long")).collect()}
    assert got == {terms[0]: long[0], terms[1]: long[1]}


@pytest.mark.parametrize(("pattern", "path", "found"), [("a_b.py", "src/a_b.py", True), ("a_b.py", "src/axb.py", False), ("50%.md", "d/50%.md", True), ("50%.md", "d/500.md", False), ("src/*.py", "src/x.py", True), ("a\\b.py", "x/a\\b.py", True), ("A_*.py", "q/a_1.py", True)])
def test_path_patterns(spark, pattern, path, found):
    assert spark.createDataFrame([(path,)], "p string").select(F.ilike("p", F.lit(C.like_pattern(pattern)))).first()[0] is found


def test_no_names(spark):
    said = ["I'm Honestly, not sure", "my name is Perhaps indeed", "my name is Testing it", "my name is Bruno and I build", "my name is Tailscale too"]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)], "session_id long, msg_idx long, role string, content string")
    assert {r.name for r in profile.name_candidates(rows).collect()} == {"Bruno", "Tailscale"}
    assert {r.name for r in profile.name_candidates(rows, products=["tailscale"]).collect()} == {"Bruno"}


@pytest.mark.parametrize("few", [0, 10_000])
def test_vocabulary_is_computed_once(spark, monkeypatch, few):
    """However many joins read it; keys of few asked words are broadcast, and the corrections are the same."""
    monkeypatch.setattr(fuzzy, "FEW", few)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("database", 3), ("search", 5), ("seared", 2), ("internationalisation", 1), ("aaa-" * 20 + "b", 1)]
    words = spark.createDataFrame(rows, "term string, frequency long").mapInPandas(counted, "term string, frequency long")
    asked = spark.createDataFrame([("databsae",), ("searc",), ("internationalization",), ("search",), ("zzzzzz",)], "term string")
    out = fuzzy.closest(asked, words)
    assert sorted((r.term, r.correction, r.edits) for r in out.collect()) == [("databsae", "database", 1), ("internationalization", "internationalisation", 1), ("searc", "search", 1)]
    assert seen.value == len(rows)
