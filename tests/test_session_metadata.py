"""Metadata of sessions read the messages once; facts are looked for where their words stand."""

from pyspark.sql import functions as F

from mnemospark.functions import patterns as P
from mnemospark.operators import extract, sessions


def test_messages_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    kind = "session_id long, msg_idx long, role string, content string"
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"Please fix the importer {i}. A key is REQUIRED for route {s}.") for s in range(3) for i in range(4)]
    out = sessions.metadata(spark.createDataFrame(rows, kind).mapInPandas(counted, kind)).collect()
    assert len(out) == 3 and all(r.message_count == 4 and r.key_facts for r in out)
    assert seen.value == len(rows)


def test_facts_are_those_of_the_patterns_alone(spark):
    """In any case of letters, and no text without the words is given to a pattern that tries every letter."""
    texts = ["A signed header is ReQuIrEd for every route here.", "you MUST NOT drop the table of the archive. Never mind", "This SECURITY hole was closed by the new release!", "nothing to see in this one.", "I decided to split the parser into steps.", None]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "session_id long, msg_idx long, role string, content string")
    plain = df.select("msg_idx", F.explode(F.concat(*[F.slice(F.regexp_extract_all("content", F.lit(p), F.lit(1)), 1, 3) for _, p in P.FACT_PATTERNS])).alias("fact"))
    got = {(r.msg_idx, r.fact) for r in extract.facts(df).collect()}
    assert got == {(r.msg_idx, r.fact.strip()) for r in plain.collect() if 20 <= len(r.fact.strip()) <= 200} and len(got) == 4
    assert "CASE WHEN" in extract.facts(df)._jdf.queryExecution().analyzed().toString()
