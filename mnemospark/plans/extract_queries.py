"""Registered queries: what messages and file operations hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.operators import extract, history, profile, stats
from mnemospark.plans.registry import EVENTS, MESSAGES, OPERATIONS, query
from mnemospark.sources.tables import events, messages, operations, table

_ERRORS = r"""x AS (SELECT session_id, msg_idx, trim(content) AS message FROM m WHERE role = 'user' AND regexp_matches(content, '^\w+Error:\s+.+')),
  y AS (SELECT *, regexp_extract(message, '((?:[A-Z][a-z]+)+Error)\s*:', 1) AS error_type,
        trim(regexp_replace(regexp_replace(message, '(?:/[^\s:,\)]+)+(?:\.[a-zA-Z0-9]+)?', '<FILE>', 'g'), 'line \d+', 'line <N>', 'gi')) AS normalised FROM x),
  z AS (SELECT *, substr(sha256(error_type || ':' || substr(normalised, 1, 200)), 1, 16) AS signature FROM y),
  er AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, signature ORDER BY msg_idx) AS r FROM z) WHERE r = 1)"""
_SOLVED = r"""so AS (SELECT session_id, msg_idx, trim(regexp_extract(content, '(?i)(?:the )?(?:fix|solution|answer) (?:is|was)[:\s]+(.{20,200})', 1)) AS solution FROM m
    WHERE role = 'assistant' AND regexp_matches(content, '(?i)(?:the )?(?:fix|solution|answer) (?:is|was)[:\s]+(.{20,200})')),
  es AS (SELECT er.session_id, er.msg_idx, er.signature, er.error_type, er.normalised, arg_min(so.solution, so.msg_idx) AS solution
    FROM er LEFT JOIN so ON er.session_id = so.session_id AND so.msg_idx BETWEEN er.msg_idx + 1 AND er.msg_idx + 3 GROUP BY ALL)"""


@query(f"WITH {MESSAGES}, {_ERRORS} SELECT session_id, msg_idx, message, error_type, normalised, signature FROM er")
def errors_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.errors(messages(spark, sf_dir)).select("session_id", "msg_idx", "message", "error_type", "normalised", "signature")


@query(f"WITH {MESSAGES}, {_ERRORS}, {_SOLVED} SELECT session_id, msg_idx, signature, solution FROM es")
def errors_with_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return extract.with_solutions(extract.errors(m), m).select("session_id", "msg_idx", "signature", "solution")


@query(f"""WITH {MESSAGES}, {_ERRORS}, {_SOLVED} SELECT signature, count(*) AS occurrence_count, arg_min(error_type, (session_id, msg_idx)) AS error_type,
  arg_min(normalised, (session_id, msg_idx)) AS normalised_message, arg_max(solution, (session_id, msg_idx)) FILTER (WHERE solution IS NOT NULL) AS solution_summary, count(DISTINCT session_id) AS sessions FROM es GROUP BY signature""")
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    found = extract.error_patterns(extract.with_solutions(extract.errors(m), m))
    return found.select("signature", "occurrence_count", "error_type", "normalised_message", "solution_summary", F.size("source_sessions").cast("long").alias("sessions"))


_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(decision), '{w}')" for w in words) + f" THEN '{c}'" for c, words in P.DECISION_CATEGORIES) + " ELSE 'general' END"
_DECISIONS = rf"""x AS (SELECT session_id, msg_idx, trim(regexp_extract(content, 'Decision:\s*([^\n]+)', 1)) AS decision FROM m WHERE role = 'assistant' AND starts_with(content, 'Decision:')),
  y AS (SELECT *, substr(sha256(substr(lower(trim(decision)), 1, 200)), 1, 16) AS hash, {_CATEGORY} AS category FROM x WHERE length(decision) >= 15),
  de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, hash ORDER BY msg_idx) AS r FROM y) WHERE r = 1)"""


@query(f"WITH {MESSAGES}, {_DECISIONS} SELECT session_id, msg_idx, decision, category, hash, 0.95::DOUBLE AS confidence FROM de")
def decisions_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.decisions(messages(spark, sf_dir))
    return d.select("session_id", "msg_idx", "decision", "category", "hash", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {MESSAGES}, {_DECISIONS}, g AS (SELECT hash, category, min(decision) AS decision, count(*) AS sessions FROM de GROUP BY hash, category) SELECT * FROM g ORDER BY sessions DESC, hash LIMIT 20")
def decisions_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.decisions(messages(spark, sf_dir)).where("confidence >= 0.75")
    return d.groupBy("hash", "category").agg(F.min("decision").alias("decision"), F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "hash").limit(20)


_CODE = r"""x AS (SELECT session_id, msg_idx, trim(regexp_extract(content, '```(\w*)\n([\s\S]*?)```', 2), ' ' || chr(10) || chr(9)) AS content, regexp_extract(content, '```(\w*)\n([\s\S]*?)```', 1) AS language FROM m WHERE contains(content, '```')),
  y AS (SELECT *, substr(sha256(session_id || ':code_block:' || substr(content, 1, 500)), 1, 32) AS hash FROM x WHERE length(content) >= 20),
  ar AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, hash ORDER BY msg_idx) AS r FROM y) WHERE r = 1)"""


@query(f"WITH {MESSAGES}, {_CODE} SELECT session_id, msg_idx, 'code_block' AS artifact_type, content, language, hash, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, length(content) AS char_count FROM ar")
def artifacts_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = extract.artifacts(messages(spark, sf_dir)).where("artifact_type = 'code_block'")
    return a.select("session_id", "msg_idx", "artifact_type", "content", "language", "hash", "line_count", "char_count")


@query(rf"WITH {MESSAGES}, {_CODE} SELECT 'code_block' AS artifact_type, count(*) AS n FROM ar UNION ALL SELECT 'error', count(*) FROM (SELECT DISTINCT session_id, substr(x, 1, 500) FROM (SELECT session_id, trim(regexp_extract(content, '(?i)(?:error|exception|traceback|failed|failure)[\s:]+.+')) AS x FROM m) WHERE length(x) >= 50) HAVING count(*) > 0")
def artifact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(extract.artifacts(messages(spark, sf_dir)), "artifact_type")


_LANGUAGE = "list_max([" + ", ".join("{'score': " + " + ".join(f"regexp_matches(content, '(?im){p}')::INT" for p in found) + f", 'o': {-i}, 'name': '{name}'}}" for i, (name, found) in enumerate(P.LANGUAGES)) + "])"


@query(f"WITH {MESSAGES}, d AS (SELECT event_id, {_LANGUAGE} AS l FROM m) SELECT event_id, CASE WHEN l.score > 0 THEN l.name END AS language FROM d")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", C.detect_language(F.col("content")).alias("language"))


@query(f"WITH {MESSAGES} SELECT session_id, msg_idx, upper(substr(c, 1, 1)) || substr(c, 2) AS task FROM (SELECT session_id, msg_idx, trim(regexp_replace(content, '(?i)^(?:hi|hello|hey)[\\s,!.]*', '')) AS c FROM m WHERE event_type = 'signup')")
def task_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("event_type = 'signup'").select("session_id", "msg_idx", C.clean_task(F.col("content")).alias("task"))


@query(f"WITH {OPERATIONS} SELECT count(*) FILTER (WHERE op = 'write') AS files_written, count(*) FILTER (WHERE op = 'edit') AS edits, count(DISTINCT file_path) AS unique_files, CAST(coalesce(sum(length(coalesce(content, new_string))), 0) // 40 AS BIGINT) AS lines FROM o")
def journey_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.journey(operations(spark, sf_dir))


@query(f"WITH {OPERATIONS} SELECT file_path, count(*) FILTER (WHERE op = 'write') AS writes, count(*) FILTER (WHERE op = 'edit') AS edits, epoch_us(max(ts)) AS last_us FROM o GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 10")
def most_active_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.most_active(operations(spark, sf_dir)).select("file_path", "writes", "edits", F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH {OPERATIONS}, sn AS (SELECT event_id, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, strlen(content) AS byte_size FROM o WHERE op = 'write') SELECT o.event_id, session_id, op, file_path, line_count, byte_size FROM o LEFT JOIN sn ON o.event_id = sn.event_id WHERE file_path ILIKE '%m3.py'")
def file_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.timeline(operations(spark, sf_dir), C.like_pattern("M3.py")).select("event_id", "session_id", "op", "file_path", "line_count", "byte_size")


_TARGETS = "tg AS (SELECT event_id AS target_id, 'src/m' || (user_id % 7) || '.py' AS file_path, ts AS target FROM e WHERE event_type = 'error')"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select(F.col("event_id").alias("target_id"), F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit(".py")).alias("file_path"), F.col("ts").alias("target"))


@query(f"""WITH {OPERATIONS}, {_TARGETS}, w AS (SELECT * FROM o WHERE op = 'write')
  SELECT target_id, tg.file_path, epoch_us(w.ts) AS snapshot_us, w.content FROM tg ASOF LEFT JOIN w ON tg.file_path = w.file_path AND w.ts <= tg.target""")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.snapshot_as_of(operations(spark, sf_dir), _targets(spark, sf_dir))
    return out.select("target_id", "file_path", F.unix_micros("snapshot_ts").alias("snapshot_us"), "content")


@query(f"""WITH {OPERATIONS}, w AS (SELECT file_path, max(ts) AS b FROM o WHERE op = 'write' GROUP BY file_path)
  SELECT o.file_path, event_id, old_string, new_string FROM o JOIN w ON o.file_path = w.file_path WHERE op = 'edit' AND ts > b - INTERVAL 1 DAY AND ts <= b""")
def edits_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    spans = ops.where("op = 'write'").groupBy("file_path").agg(F.max("ts").alias("end")).select("file_path", F.col("file_path").alias("span_id"), (F.col("end") - F.expr("interval 1 day")).alias("start"), "end")
    return history.edits_between(ops, spans).select("file_path", "event_id", "old_string", "new_string")


@query(f"""WITH RECURSIVE {OPERATIONS}, w AS (SELECT file_path, arg_max(content, (ts, event_id)) AS content, max((ts, event_id)) AS last_ FROM o WHERE op = 'write' GROUP BY file_path),
  ed AS (SELECT o.file_path, old_string, new_string, replace_all, row_number() OVER (PARTITION BY o.file_path ORDER BY ts, event_id) AS i FROM o JOIN w ON o.file_path = w.file_path WHERE op = 'edit' AND (ts, event_id) > last_),
  f AS (SELECT file_path, content, 0::BIGINT AS i, 0::BIGINT AS applied FROM w UNION ALL
    SELECT f.file_path, CASE WHEN NOT contains(f.content, old_string) THEN f.content WHEN replace_all THEN replace(f.content, old_string, new_string)
      ELSE substr(f.content, 1, position(old_string IN f.content) - 1) || new_string || substr(f.content, position(old_string IN f.content) + length(old_string)) END, f.i + 1, applied + contains(f.content, old_string)::BIGINT
    FROM f JOIN ed ON f.file_path = ed.file_path AND ed.i = f.i + 1)
  SELECT file_path, arg_max(content, i) AS content, max(applied) AS edits_applied, max(i) - max(applied) AS edits_failed, CASE WHEN max(i) > 0 THEN round(0.95::DOUBLE * max(applied) / max(i), 4) ELSE 0.95::DOUBLE END AS confidence FROM f GROUP BY file_path""")
def file_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.reconstruct(operations(spark, sf_dir))


_NAMES = r"""c AS (SELECT DISTINCT session_id, regexp_extract(content, 'my name is\s+([A-Z][a-z]{2,15})', 1) AS name FROM m WHERE event_type = 'signup')"""


@query(f"WITH {MESSAGES}, {_NAMES} SELECT name, count(DISTINCT session_id) AS sessions, round(0.95::DOUBLE * count(*) * 1.5::DOUBLE + ln(count(DISTINCT session_id) + 1.0), 4) AS score FROM c GROUP BY name")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.name_scores(profile.name_candidates(messages(spark, sf_dir)))


_RULES = r"""ru AS (SELECT session_id, msg_idx, trim(regexp_extract(content, '(?i)(?:do not|don''t|never|stop|quit)\s+([^.!?\n]{10,80})', 1)) AS rule_text FROM m WHERE role = 'user' AND regexp_matches(content, '(?i)(?:do not|don''t|never|stop|quit)\s+([^.!?\n]{10,80})'))"""


@query(f"WITH {MESSAGES}, {_RULES} SELECT 'prohibit' AS rule_type, lower(rule_text) AS rule_text, count(*) AS frequency, round(least(1.0, 0.80::DOUBLE + 0.05::DOUBLE * (count(*) - 1)), 4) AS confidence FROM ru GROUP BY 2")
def rule_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rule_frequencies(profile.rules(messages(spark, sf_dir)))


@query(r"""WITH w AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM part),
  s AS (SELECT w, min(id) AS id FROM w GROUP BY w), p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS n FROM s x JOIN s y ON x.id < y.id)
  SELECT a, b, round(i / (n - i)::DOUBLE, 4) AS similarity FROM p WHERE i / (n - i)::DOUBLE >= 0.7""")
def rules_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return profile.similar_pairs(parts, "p_partkey", "text")


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, count(*) AS frequency, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 86400e6 AS age FROM e GROUP BY user_id)
  SELECT user_id, frequency, round(least(1.0, 0.6::DOUBLE * CASE WHEN age < 7 THEN 1.0::DOUBLE WHEN age < 30 THEN 0.85 WHEN age < 90 THEN 0.70 ELSE 0.50 END * least(1.2::DOUBLE, 1 + 0.05::DOUBLE * (frequency - 1))), 2) AS effective FROM r""")
def rules_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("frequency"), F.max("ts").alias("last_seen")).withColumn("confidence", F.lit(0.6))
    return profile.decayed_rules(r, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("user_id", "frequency", "effective")


_ZONES = r"""z AS (SELECT regexp_extract(content, '(?i)(?:issue)\s+(?:in)\s+`?([a-zA-Z_][a-zA-Z0-9_/\-]*\.[a-zA-Z]{1,4})`?', 1) AS path_pattern, ts FROM m WHERE regexp_matches(content, '(?i)issue\s+in\s+')), zo AS (SELECT path_pattern, count(*) AS issue_count, epoch_us(max(ts)) AS last_us FROM z GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"WITH {MESSAGES}, {_ZONES} SELECT * FROM zo")
def danger_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = extract.danger_zones(messages(spark, sf_dir), 2)
    return z.select("path_pattern", "issue_count", F.unix_micros("last_seen").alias("last_us"))


@query(f"WITH {MESSAGES}, {_ZONES}, o AS (SELECT event_id, 'src/m' || (user_id % 7) || '.py' AS file_path FROM events WHERE event_type IN ('purchase', 'click')) SELECT event_id, path_pattern, issue_count FROM o JOIN zo ON contains(lower(file_path), lower(path_pattern))")
def zones_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = extract.danger_zones(messages(spark, sf_dir), 2)
    return profile.zones_of_files(operations(spark, sf_dir).select("event_id", "file_path"), zones).select("event_id", "path_pattern", "issue_count")


@query("SELECT p_partkey FROM part WHERE lower(p_type) IN ('all', 'always', 'any', 'everywhere') OR contains(lower(p_type), 'eco') OR contains('eco', lower(p_type)) OR contains(lower(p_type), 'small box') OR contains('small box', lower(p_type))")
def prereq_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.applicable(table(spark, sf_dir, "part").withColumnRenamed("p_type", "environment"), ["ECO", "small box"]).select("p_partkey")


def _phase(words: list[str]) -> str:
    return "min(CASE WHEN " + " OR ".join("contains(lower(content), '" + w.replace("'", "''") + "')" for w in words) + " THEN pos END)"


_LIFE = ", ".join(f"{_phase(w)} AS {p}" for p, w in P.LIFECYCLE_SIGNALS)


#: From user messages lm (session_id, pos, content) the lifecycle of each session, as the last of several tables.
LIFECYCLE = f"""lf AS (SELECT session_id, count(*) AS n, {_LIFE} FROM lm GROUP BY session_id HAVING count(*) >= 3),
  lp AS (SELECT session_id, list_sort(list_filter([{{'pos': plan, 'o': 0, 'p': 'plan'}}, {{'pos': test_first, 'o': 1, 'p': 'test_first'}}, {{'pos': implement, 'o': 2, 'p': 'implement'}}, {{'pos': test_after, 'o': 3, 'p': 'test_after'}},
       {{'pos': CASE WHEN "commit" > 1 AND "commit" <= n * 0.8 THEN "commit" END, 'o': 6, 'p': 'commit'}}], lambda x: x.pos IS NOT NULL))[1:4] AS ph FROM lf),
  lq AS (SELECT session_id, list_transform(ph, lambda x: x.p) AS ph FROM lp WHERE len(ph) >= 2),
  lc AS (SELECT session_id, array_to_string(list_transform(ph, lambda x: CASE x WHEN 'plan' THEN 'Plan' WHEN 'test_first' THEN 'Write Tests' WHEN 'implement' THEN 'Implement' WHEN 'test_after' THEN 'Test' ELSE 'Commit' END), ' -> ') AS sequence,
    round(least(1.0::DOUBLE, least(len(ph) / 4.0::DOUBLE, 1.0) * 0.55::DOUBLE + CASE WHEN ph[1] = 'plan' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN list_contains(ph, 'test_first') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_contains(ph, 'commit') THEN 0.1::DOUBLE ELSE 0 END), 2) AS confidence FROM lq)"""


@query(f"""WITH {EVENTS}, lm AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CASE event_type WHEN 'error' THEN 'let me think about the design' WHEN 'click' THEN 'implement it' WHEN 'signup' THEN 'write test cases' WHEN 'view' THEN 'push it' ELSE 'nothing' END AS content FROM e), {LIFECYCLE} SELECT session_id, sequence, confidence FROM lc""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"error": "let me think about the design", "click": "implement it", "signup": "write test cases", "view": "push it"}
    said = F.lit("nothing")
    for kind, text in words.items():
        said = F.when(F.col("event_type") == kind, text).otherwise(said)
    m = messages(spark, sf_dir).withColumn("content", said).withColumn("role", F.lit("user"))
    return profile.lifecycle(m)


#: Two patterns on the derived messages, to show the accumulation; preferences_all has all patterns of the library.
_PREFERENCES = [("tools", r"(?:restart|worker)\s+(\w+ ?\w*)", 0.8), ("naming", r"my name is (\w+)", 0.7)]


@query(f"""WITH {MESSAGES}, p AS (SELECT session_id, 'naming' AS category, trim(regexp_extract(lower(content), 'my name is (\\w+)', 1)) AS preference FROM m WHERE event_type = 'signup')
  SELECT category, preference, count(*) AS frequency, count(DISTINCT session_id) AS sessions, round(least(1.0, 0.7::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 4) AS confidence FROM p GROUP BY 1, 2""")
def preferences_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preferences(messages(spark, sf_dir), _PREFERENCES)


@query(f"WITH {OPERATIONS} SELECT file_path, count(*) AS writes, CAST(sum(length(content)) AS BIGINT) AS chars FROM o WHERE op = 'write' GROUP BY 1")
def file_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(spark, sf_dir).where("op = 'write'").groupBy("file_path").agg(F.count("*").alias("writes"), F.sum(F.length("content")).alias("chars"))
