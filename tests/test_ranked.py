"""English stems against the algorithm's public sample, and ranks of near words against a brute-force version."""

import math
import random

from pyspark.sql import functions as F

from mnemospark.functions import stemming
from mnemospark.operators import search

# Words and stems of the algorithm's public sample, and of its rules.
SAMPLE = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist,
consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol,
consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson,
consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir,
conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc,
constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee,
kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight,
knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock,
knocker knocker, knockers knocker, knocking knock, knopp knopp, knot knot, knots knot,
generate generat, generic generic, generically generic, general general, generally general, generous generous, communism communism, hoping hope, hopped hop,
national nation, skies sky, dying die, cries cri, ties tie, gas gas, this this, kiwis kiwi, gaps gap, proceed proceed, luxuriate luxuri, say say, by by, cry cri,
youth youth, hopefulness hope, relational relat, conditional condit, operator oper, feudalism feudal, sensibility sensibl, geology geolog, early earli,
happy happi, fully fulli, adoption adopt, controlling control, bed bed, agreed agre, feed feed, motoring motor
"""
PAIRS = [tuple(pair.split()) for pair in SAMPLE.replace("\n", " ").split(",")]


def test_stems_of_the_public_sample(spark):
    assert [(w, stemming.stem(w)) for w, _ in PAIRS] == PAIRS
    frame = spark.createDataFrame([*PAIRS, (None, None), ("", ""), ("y", "y"), ("a1", "a1")], "word string, stem string")
    assert frame.where(~stemming.stem_column(F.col("word")).eqNullSafe(F.col("stem"))).count() == 0


def test_engines_agree_and_beginnings_stay(spark):
    import duckdb

    dice = random.Random(3)
    endings = sorted({e for step in stemming._USUAL for _, e, _ in step if "!" not in e and e.islower()})
    parts = ["", "gener", "commun", "arsen", "ski", "d", "bl", "qu", "y", "yo", "aab", "hop", "tt", "ly"]
    words = sorted({dice.choice(parts) + "".join(dice.choice("abeilrstyz") for _ in range(dice.randrange(5))) + "".join(dice.choice(endings) for _ in range(dice.randrange(4))) for _ in range(1000)} - {""})
    expected = {w: stemming.stem(w) for w in words}
    assert all(w.startswith(stemming.kept_beginning(s)) for w, s in expected.items())
    assert all("~" not in s and "!" not in s and "=" not in s for s in expected.values())
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in frame.select("w", stemming.stem_column(F.col("w")).alias("s")).collect()} == expected
    made = frame.toPandas()  # noqa: F841
    assert dict(duckdb.sql(f"SELECT w, {stemming.stem_sql('w')} FROM made").fetchall()) == expected


def brute(text: str, query: list[str]) -> float | None:
    places = {t: [] for t in query}
    for i, w in enumerate(text.lower().split()):
        if w not in stemming.ENGLISH_STOPWORDS and stemming.stem(w) in places:
            places[stemming.stem(w)].append(i)
    if not all(places.values()):
        return None
    if len(query) == 1:
        return 0.1 * sum(1 / (j + 1) ** 2 for j in range(len(places[query[0]]))) / 1.64493406685
    left = 1.0
    for a in query:
        for b in query:
            for p in places[a] if a < b else []:
                for q in places[b]:
                    left *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))) if abs(p - q) <= 100 else 1
    return 1 - left


def test_ranks_are_those_of_brute_force(spark):
    dice = random.Random(5)
    words = ["hoping", "hope", "hopes", "motor", "motoring", "the", "and", "nation", "x", "knitted"]
    texts = [" ".join(dice.choice(words[dice.randrange(10) :]) for _ in range(dice.randrange(600))) for _ in range(60)] + ["hope " + "x " * 300 + "motors", "Hope", "", "hope hope", "hope hope"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string").withColumn("hits", F.lit("clashing")).withColumn("rank", F.lit(1))
    for asked, stems in [("hoped motors", ["hope", "motor"]), ("The hope", ["hope"]), ("knits and nations hoping", ["hope", "knit", "nation"])]:
        found = {r.id: r["rank"] for r in search.ranked(docs, ["id"], ["text"], asked).collect()}
        expected = {i: brute(t, stems) for i, t in enumerate(texts)}
        expected = {i: r for i, r in expected.items() if r is not None}
        assert set(found) == set(expected) and expected
        assert all(abs(found[i] - expected[i]) < 1e-9 for i in expected)
        assert {(r.id, round(r["rank"], 9)) for r in search.ranked(docs, ["id"], ["text"], asked, most=1).collect()} == {(i, round(r, 9)) for i, r in found.items()}
        top = search.ranked(docs, ["id"], ["text"], asked, 5).collect()
        assert [r.id for r in top] == sorted(expected, key=lambda i: (-round(expected[i], 9), i))[:5]
    assert search.ranked(docs, ["id"], ["text"], "the of").count() == 0 == search.ranked(docs.limit(0), ["id"], ["text"], "hope").count()
