"""Registered queries: what the told sentences say, pattern by pattern, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions import gates as G
from mnemospark.functions import patterns as P
from mnemospark.operators import context, extract, history, profile, sessions, stats, upsert
from mnemospark.plans.extract_queries import LIFECYCLE
from mnemospark.plans.registry import _LITERAL, OPERATIONS, SAID, any_of, letters, matches, query, starts, strip
from mnemospark.sources.tables import operations, said, table

_ISIN = lambda words: ", ".join(_LITERAL(w) for w in words)
_FIRST = lambda rows, key, order: f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {rows}) WHERE r = 1"


# --- errors, decisions, artifacts -------------------------------------------------------------------------------------
_REWRITE = "message"
for _p, _to in P.ERROR_REWRITES:
    _flags = "gi" if _p.startswith("(?i)") else "g"
    _REWRITE = f"regexp_replace({_REWRITE}, {_LITERAL(_p.removeprefix('(?i)'))}, {_LITERAL(_to)}, '{_flags}')"
_TYPE = "coalesce(" + ", ".join(f"nullif(regexp_extract(message, {_LITERAL('(?im)' + p)}, 1), '')" for p in P.ERROR_TYPES) + ")"
_ALL_ERRORS = f"""ea AS ({matches("(SELECT * FROM s WHERE role = 'user')", [("(?ms)" + p, 1, {"kind": kind, "confidence": c}) for p, kind, c in P.ERROR_PATTERNS])}),
  eb AS (SELECT *, {strip("found")} AS message FROM ea),
  ec AS (SELECT *, {_TYPE} AS error_type, {strip(_REWRITE)} AS normalised FROM eb WHERE length(message) >= 10),
  ed AS (SELECT *, substr(sha256(coalesce(error_type || ':', '') || substr(normalised, 1, 200)), 1, 16) AS signature FROM ec),
  ee AS ({_FIRST("ed", "session_id, signature", "msg_idx, place, pos")}),
  so AS (SELECT session_id, msg_idx, coalesce({", ".join(f"nullif(substr({strip(f'regexp_extract(content, {_LITERAL(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 1)')}, 1, 200), '')" for p in P.SOLUTION_PATTERNS)}) AS solution FROM s WHERE role = 'assistant'),
  es AS (SELECT ee.session_id, ee.msg_idx, any_value(kind) AS kind, any_value(message) AS message, any_value(error_type) AS error_type, ee.signature, any_value(confidence) AS confidence,
         arg_min(solution, so.msg_idx) FILTER (WHERE solution IS NOT NULL) AS solution
         FROM ee LEFT JOIN so ON ee.session_id = so.session_id AND so.msg_idx BETWEEN ee.msg_idx + 1 AND ee.msg_idx + 3 GROUP BY ee.session_id, ee.msg_idx, ee.signature)"""


@query(f"WITH {SAID}, {_ALL_ERRORS} SELECT session_id, msg_idx, kind, message, error_type, signature, confidence, solution FROM es")
def errors_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir)
    return extract.with_solutions(extract.errors(m), m).select("session_id", "msg_idx", "kind", "message", "error_type", "signature", F.col("confidence").cast("double").alias("confidence"), "solution")


@query(f"WITH {SAID}, {_ALL_ERRORS}, p AS (SELECT signature, count(*) AS n, count(solution) AS solved FROM es GROUP BY signature) SELECT count(*) AS total, count(*) FILTER (WHERE solved > 0) AS with_solution, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences FROM p")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir)
    return stats.error_stats(extract.error_patterns(extract.with_solutions(extract.errors(m), m)))


_CATEGORY = "CASE " + " ".join("WHEN " + any_of("lower(decision)", words) + f" THEN '{c}'" for c, words in P.DECISION_CATEGORIES) + " ELSE 'general' END"
_ALL_DECISIONS = f"""da AS ({matches("(SELECT * FROM s WHERE role = 'assistant')", [("(?im)" + p, 1, {"confidence": c, "source": source}) for p, c, source in P.DECISION_PATTERNS], columns="session_id, msg_idx, ts")}),
  db AS (SELECT *, {strip("found")} AS decision FROM da),
  dc AS (SELECT *, substr(sha256(substr(lower(decision), 1, 200)), 1, 16) AS hash, {_CATEGORY} AS category FROM db WHERE length(decision) >= 15),
  de AS ({_FIRST("dc", "session_id, hash", "msg_idx, place, pos")})"""


@query(f"WITH {SAID}, {_ALL_DECISIONS} SELECT session_id, msg_idx, decision, category, hash, confidence, source FROM de")
def decisions_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.decisions(said(spark, sf_dir))
    return d.select("session_id", "msg_idx", "decision", "category", "hash", F.col("confidence").cast("double").alias("confidence"), "source")


@query(f"WITH {SAID}, {_ALL_DECISIONS} SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.8) AS high_confidence, count(DISTINCT category) AS categories FROM de")
def decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.decision_stats(extract.decisions(said(spark, sf_dir)))


@query(f"""WITH {SAID}, {_ALL_DECISIONS}, o AS (SELECT hash, arg_min(decision, (session_id, msg_idx)) AS decision, max(confidence) AS confidence FROM de WHERE session_id % 2 = 0 GROUP BY hash),
  n AS (SELECT hash, arg_min(decision, (session_id, msg_idx)) AS decision, max(confidence) AS confidence FROM de WHERE session_id % 2 = 1 GROUP BY hash)
  SELECT hash, coalesce(o.decision, n.decision) AS decision, greatest(o.confidence, n.confidence) AS confidence FROM o FULL JOIN n USING (hash)""")
def decisions_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.decisions(said(spark, sf_dir))
    one = lambda rows: rows.groupBy("hash").agg(F.min_by("decision", F.struct("session_id", "msg_idx")).alias("decision"), F.max(F.col("confidence").cast("double")).alias("confidence"))
    return upsert.merge(one(d.where("session_id % 2 = 0")), one(d.where("session_id % 2 = 1")), ["hash"], {"decision": "first", "confidence": "max"})


_SOUND = f"""length(decision) >= 15 AND NOT {any_of("lower(decision)", P.NO_SUMMARIES)} AND regexp_matches(decision, '^\\p{{Lu}}') AND NOT {starts("lower(decision)", P.DIRECTIVES)} AND NOT {any_of("lower(decision)", P.PROBLEMS)}
  AND NOT contains(substr(decision, 1, 20), ' - ') AND NOT regexp_matches(decision, '[\\[(\\-:,]\\s*$') AND {letters("decision")} >= 0.8"""


@query(f"WITH {SAID}, {_ALL_DECISIONS}, f AS ({_FIRST('de', 'hash', 'session_id, msg_idx')}), t AS (SELECT * FROM f WHERE confidence >= 0.75 ORDER BY confidence DESC, ts DESC, hash LIMIT 60) SELECT hash, substr(decision, 1, 120) AS decision, category FROM t WHERE {_SOUND} ORDER BY confidence DESC, ts DESC, hash LIMIT 20")
def structured_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir)
    d = extract.first_of(extract.decisions(m).join(m.select("session_id", "msg_idx", "ts"), ["session_id", "msg_idx"]), ["hash"], ["session_id", "msg_idx"])
    return context.structured_decisions(d.withColumn("reasoning", F.lit(None).cast("string")), 20).drop("reasoning")


@query(f"""WITH {SAID}, u AS (SELECT session_id, msg_idx, role, list_sort(list_distinct(list_filter(regexp_extract_all(content, {_LITERAL(P.URL)}), lambda u: length(u) > 20 AND NOT contains(u, 'example.com')))) AS x FROM s),
  c AS (SELECT session_id, msg_idx, 'code_block' AS artifact_type, {strip("regexp_extract(content, '```(\\w*)\\n([\\s\\S]*?)```', 2)")} AS content, lower(regexp_extract(content, '```(\\w*)\\n([\\s\\S]*?)```', 1)) AS language FROM s WHERE contains(content, '```')),
  l AS (SELECT session_id, msg_idx, 'list' AS artifact_type, {strip("regexp_extract(content, '(?m)(?:^(?:[0-9]+[.)]|[-*+])\\s+.+\\n?)+')")} AS content, NULL AS language FROM s WHERE starts_with(content, 'Plan:') OR starts_with(content, 'Parts:')),
  t AS (SELECT session_id, msg_idx, 'table' AS artifact_type, {strip("content")} AS content, NULL AS language FROM s WHERE starts_with(content, '| name')),
  j AS (SELECT session_id, msg_idx, 'config' AS artifact_type, content, 'json' AS language FROM s WHERE starts_with(content, '{{"name"')),
  b AS (SELECT session_id, msg_idx, 'url' AS artifact_type, array_to_string(x, chr(10)) AS content, NULL AS language FROM u WHERE len(x) >= 2),
  a AS (SELECT * FROM c UNION ALL SELECT * FROM l UNION ALL SELECT * FROM t UNION ALL SELECT * FROM j UNION ALL SELECT * FROM b),
  h AS (SELECT *, substr(sha256(session_id || ':' || artifact_type || ':' || substr(content, 1, 500)), 1, 32) AS hash FROM a)
  SELECT artifact_type, language, content, hash, length(content) AS char_count FROM ({_FIRST("h", "session_id, hash", "msg_idx")})""")
def artifacts_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.artifacts(said(spark, sf_dir)).where("artifact_type <> 'error'").select("artifact_type", "language", "content", "hash", "char_count")


# --- names, preferences, rules ----------------------------------------------------------------------------------------
_BLOCKED = _ISIN(sorted({*P.NO_NAMES, *P.TECHNOLOGIES, *P.FUZZY_STOPWORDS, *P.FILTER_WORDS}))
_NAME = lambda text, p: f"CASE WHEN regexp_full_match(regexp_extract({text}, {_LITERAL(p)}, 1), '[A-Z][a-z]{{2,14}}') AND lower(regexp_extract({text}, {_LITERAL(p)}, 1)) NOT IN ({_BLOCKED}) THEN regexp_extract({text}, {_LITERAL(p)}, 1) END"
_TAIL = "right(content, 100)"
_NAMES = f"""na AS (SELECT session_id, msg_idx, {", ".join(f"{_NAME('content', p)} AS n{i}" for i, (p, _, _) in enumerate(P.NAME_PATTERNS))}, {_NAME(_TAIL, P.SIGN_OFF[0])} AS n9 FROM s WHERE role = 'user' AND length(content) >= 10),
  nb AS (SELECT *, coalesce(n0, n1, n2, n3) AS intro, min(msg_idx) OVER (PARTITION BY session_id) AS first_ FROM na WHERE coalesce(n0, n1, n2, n3, n9) IS NOT NULL),
  nc AS (SELECT session_id, msg_idx, coalesce(intro, n9) AS name, CASE {" ".join(f"WHEN n{i} IS NOT NULL THEN '{kind}'" for i, (_, kind, _) in enumerate(P.NAME_PATTERNS))} ELSE 'signoff' END AS pattern,
         CASE {" ".join(f"WHEN n{i} IS NOT NULL THEN {c}::DOUBLE" for i, (_, _, c) in enumerate(P.NAME_PATTERNS))} ELSE 0.75 END AS confidence FROM nb WHERE intro IS NOT NULL OR msg_idx = first_),
  nd AS (SELECT session_id, name, arg_max(pattern, msg_idx) AS pattern, max(confidence) AS confidence FROM nc GROUP BY session_id, name)"""


@query(f"WITH {SAID}, {_NAMES} SELECT * FROM nd")
def name_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.name_candidates(said(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH {SAID}, {_NAMES} SELECT name, count(DISTINCT session_id) AS sessions,
  round(sum(confidence) * max(CASE pattern {" ".join(f"WHEN '{k}' THEN {w}" for k, w in P.NAME_WEIGHTS.items())} ELSE {P.OTHER_NAME_WEIGHT} END)::DOUBLE + ln(count(DISTINCT session_id) + 1.0), 4) AS score FROM nd GROUP BY name""")
def name_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.name_scores(profile.name_candidates(said(spark, sf_dir)))


_PREFERENCES = f"""pa AS ({matches(f"(SELECT session_id, msg_idx, lower(content) AS content FROM s WHERE role = 'user' AND NOT {any_of('lower(content)', P.PREFERENCE_NOISE)})", [(p, 1, {"category": c, "confidence": w}) for c, p, w in P.PREFERENCE_PATTERNS])}),
  pb AS (SELECT *, {strip("found")} AS preference FROM pa),
  pc AS (SELECT * FROM pb WHERE length(preference) BETWEEN 3 AND 50 AND NOT {any_of("preference", [*P.FILTER_WORDS, "**", "`", "("])}),
  pd AS (SELECT category, preference, count(*) AS frequency, count(DISTINCT session_id) AS sessions, round(least(1.0, arg_min(confidence, (session_id, msg_idx, place)) + 0.1::DOUBLE * (count(*) - 1)), 4) AS confidence FROM pc GROUP BY category, preference)"""


@query(f"WITH {SAID}, {_PREFERENCES} SELECT * FROM pd")
def preferences_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preferences(said(spark, sf_dir))


@query(f"WITH {SAID}, {_PREFERENCES} SELECT category, preference, frequency FROM pd WHERE confidence >= 0.5 AND preference NOT IN ({_ISIN(P.APPROVALS)}) ORDER BY category, frequency DESC, preference LIMIT 50")
def preferences_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.preferences(said(spark, sf_dir))
    return p.where((F.col("confidence") >= 0.5) & ~profile.is_approval(F.col("preference"))).orderBy("category", F.desc("frequency"), "preference").limit(50).select("category", "preference", "frequency")


def _rule_matches() -> str:
    parts = []
    user = f"(SELECT * FROM s WHERE role = 'user' AND NOT {any_of('lower(content)', P.RULE_NOISE)})"
    for i, (kind, p, c) in enumerate([*P.RULE_PATTERNS, *P.CONDITIONAL_PATTERNS]):
        g = lambda n, p=p: f"regexp_extract_all(content, {_LITERAL(p)}, {n})"
        two, conditional = p.count("([a-zA-Z0-9_-]+)") == 2, i >= len(P.RULE_PATTERNS)
        text = f"list_transform(list_zip({g(1)}, {g(2)}), lambda z: z[1] || ' over ' || z[2])" if two else g(2) if conditional else g(1)
        own = g(1) if conditional else f"list_transform({g(1)}, lambda z: NULL::VARCHAR)"
        parts.append(f"SELECT session_id, msg_idx, content, {i} AS place, '{kind}' AS rule_type, {c}::DOUBLE AS confidence, unnest({text}) AS found, unnest({own}) AS own, generate_subscripts({g(1)}, 1) AS pos FROM {user}")
    return " UNION ALL ".join(parts)


_SCOPE = "coalesce(" + ", ".join(f"CASE WHEN x{i} <> '' AND x{i} NOT IN ({_ISIN(P.NO_SCOPES)}) THEN x{i} END" for i in range(len(P.SCOPE_PATTERNS))) + ")"
_ALL_RULES = f"""ra AS (SELECT *, row_number() OVER (PARTITION BY session_id, msg_idx ORDER BY place, pos) - 1 AS nth FROM ({_rule_matches()})),
  rb AS (SELECT *, {strip("found")} AS rule_text, {", ".join(f"{strip(f'regexp_extract(lower(content), {_LITERAL(p)}, 1)')} AS x{i}" for i, p in enumerate(P.SCOPE_PATTERNS))} FROM ra),
  rc AS (SELECT session_id, msg_idx, nth, place, rule_type, rule_text, confidence, CASE WHEN place < {len(P.RULE_PATTERNS)} THEN {_SCOPE} ELSE {strip("own")} END AS scope FROM rb
    WHERE length(rule_text) BETWEEN 5 AND 150 AND NOT suffix({strip("content")}, '?') AND NOT {any_of("lower(content)", P.NO_RULE_MESSAGES)} AND NOT {any_of("lower(rule_text)", P.RULE_FILTER_WORDS)}
      AND NOT {any_of("rule_text", P.NO_RULE_SIGNS)} AND NOT regexp_matches(rule_text, '^[-*]') AND NOT regexp_matches(rule_text, '^[0-9][.):]') AND {letters("rule_text")} >= 0.75 AND NOT {any_of("lower(rule_text)", P.NO_RULE_PHRASES)})"""


@query(f"WITH {SAID}, {_ALL_RULES} SELECT session_id, msg_idx, rule_type, rule_text, scope, confidence FROM rc")
def rules_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rules(said(spark, sf_dir)).select("session_id", "msg_idx", "rule_type", "rule_text", "scope", F.col("confidence").cast("double").alias("confidence"))


_WORDS = lambda text: f"list_filter(string_split_regex(trim(regexp_replace(lower({text}), '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ({_ISIN(P.RULE_FILLERS)}) AND length(w) > 1)"

_REVOCATIONS = f"""va AS (SELECT *, row_number() OVER (PARTITION BY session_id, msg_idx ORDER BY place, pos) - 1 AS nth FROM ({matches(f"(SELECT session_id, msg_idx, lower(content) AS content FROM s WHERE role = 'user' AND NOT {any_of('lower(content)', P.RULE_NOISE)})", [(p, 1, {}) for p in P.REVOCATION_PATTERNS])})),
  vb AS (SELECT session_id, msg_idx, nth, {_WORDS("found")} AS w FROM va), vc AS (SELECT session_id, msg_idx, nth, list_distinct(w) AS words FROM vb WHERE length(array_to_string(w, ' ')) >= 5)"""
_RULE = "STRUCT(kind VARCHAR, words VARCHAR[], text VARCHAR, scope VARCHAR, n BIGINT, c DOUBLE, s BIGINT, m BIGINT, revoked BOOLEAN)"
_COMMON = "len(list_intersect(x.words, ev.words))::DOUBLE"
_LIKE = f"CASE WHEN x.kind = ev.kind AND NOT x.revoked THEN {_COMMON} / (len(x.words) + len(ev.words) - {_COMMON}) ELSE 0.0::DOUBLE END"
_FIELDS = "kind := x.kind, words := x.words, text := x.text, scope := x.scope"


@query(f"""WITH RECURSIVE {SAID}, {_ALL_RULES}, {_REVOCATIONS},
  said AS (SELECT session_id, msg_idx, nth, 0 AS side, rule_type AS kind, substr(rule_text, 1, 200) AS text, scope, confidence, list_distinct({_WORDS("substr(rule_text, 1, 200)")}) AS words FROM rc
    UNION ALL SELECT session_id, msg_idx, nth, 1, NULL, NULL, NULL, NULL, words FROM vc),
  ev AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY session_id, msg_idx, nth, side) AS i FROM said WHERE len(words) > 0),
  fold AS (SELECT 0::BIGINT AS i, []::{_RULE}[] AS kept
    UNION ALL SELECT i, CASE WHEN kind IS NULL THEN list_transform(kept, lambda x: struct_pack({_FIELDS}, n := x.n, c := x.c, s := x.s, m := x.m, revoked := x.revoked OR common(x.words, words)))
      WHEN best IS NULL THEN list_append(kept, struct_pack(kind := kind, words := words, text := text, scope := scope, n := 1::BIGINT, c := confidence, s := session_id, m := msg_idx, revoked := false))
      ELSE list_transform(kept, lambda x, j: struct_pack({_FIELDS}, n := x.n + (j = best)::BIGINT, c := CASE WHEN j = best THEN least(1.0::DOUBLE, greatest(x.c, confidence) + 0.05::DOUBLE) ELSE x.c END, s := x.s, m := x.m, revoked := x.revoked)) END
    FROM (SELECT ev.*, kept, list_transform(kept, lambda x: {_LIKE}) AS likes, CASE WHEN len(kept) > 0 AND list_max(likes) >= 0.7 THEN list_position(likes, list_max(likes)) END AS best FROM fold JOIN ev ON ev.i = fold.i + 1)),
  last AS (SELECT unnest(kept) AS r FROM (SELECT kept FROM fold ORDER BY i DESC LIMIT 1))
  SELECT r.kind AS rule_type, r.text AS rule_text, r.scope AS scope, r.n AS frequency, round(r.c, 4) AS confidence, r.s AS first_session, r.m AS first_msg, r.revoked AS revoked FROM last""".replace("common(x.words, words)", "len(list_intersect(x.words, words)) >= 0.5 * len(x.words)"))
def rules_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after folding similar ones and revocations in order; the SQL folds statement by statement."""
    m = said(spark, sf_dir)
    out = profile.learned_rules(profile.rules(m), profile.revocations(m))
    return out.select("rule_type", "rule_text", "scope", "frequency", F.round("confidence", 4).alias("confidence"), F.col("first_seen.session_id").alias("first_session"), F.col("first_seen.msg_idx").alias("first_msg"), "revoked")


@query(f"WITH {SAID}, {_REVOCATIONS} SELECT session_id, msg_idx, array_to_string(list_sort(words), ' ') AS words FROM vc")
def rule_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.revocations(said(spark, sf_dir)).select("session_id", "msg_idx", F.array_join(F.array_sort("words"), " ").alias("words"))


@query(f"""WITH p AS (SELECT p_partkey, p_name || ', with the ' || p_type AS t FROM part), c AS (SELECT *, substr(t, 1, 30) AS cut FROM p), d AS (SELECT *, regexp_extract(cut, '^([\\s\\S]*) [^ ]*$', 1) AS word FROM c)
  SELECT p_partkey, array_to_string({_WORDS("t")}, ' ') AS normalised, CASE WHEN length(t) <= 30 THEN t ELSE regexp_replace(CASE WHEN length(word) > 18 THEN word ELSE cut END, '[.,;:]+$', '') || '...' END AS shown FROM d""")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(", with the "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", G.normalised_rule(text).alias("normalised"), G.shown_rule(text, 30).alias("shown"))


# --- zones, prerequisites, ways of working ---------------------------------------------------------------------------
_ALL_ZONES = f"""za AS ({matches("(SELECT * FROM s WHERE NOT (" + " OR ".join(f"regexp_matches(content, {_LITERAL('(?i)' + p)})" for p in P.NO_ZONE_MESSAGES) + "))", [(p, 1, {}) for p in P.ZONE_PATTERNS], columns="session_id, msg_idx, ts, content")}),
  zb AS (SELECT found AS path_pattern, count(*) AS issue_count, epoch_us(max(ts)) AS last_us FROM za WHERE length(found) BETWEEN 5 AND 100 AND regexp_matches(found, {_LITERAL(P.ZONE_EXTENSIONS)}) GROUP BY found)"""


@query(f"WITH {SAID}, {_ALL_ZONES} SELECT * FROM zb")
def zones_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.danger_zones(said(spark, sf_dir)).select("path_pattern", "issue_count", F.unix_micros("last_seen").alias("last_us"))


@query(f"WITH {SAID}, {_ALL_ZONES}, f AS (SELECT DISTINCT 'src/m' || (user_id % 7) || '.py' AS file_path FROM e WHERE event_type = 'click' AND user_id % 2 = 0) SELECT path_pattern, issue_count FROM zb WHERE EXISTS (SELECT 1 FROM f WHERE contains(lower(file_path), lower(path_pattern)))")
def zone_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = operations(spark, sf_dir).where("op = 'edit' and session_id % 2 = 0").select("file_path")
    return profile.zone_alerts(extract.danger_zones(said(spark, sf_dir)), files).select("path_pattern", "issue_count")


_AS_PAIR = lambda p: f"list_zip(regexp_extract_all(content, {_LITERAL(p)}, 1), regexp_extract_all(content, {_LITERAL(p)}, 2))"
_COMMAND = "coalesce(" + ", ".join(f"CASE WHEN length({strip(f'regexp_extract(content, {_LITERAL(p)}, 1)')}) BETWEEN 4 AND 499 THEN {strip(f'regexp_extract(content, {_LITERAL(p)}, 1)')} END" for p in P.PREREQUISITE_COMMANDS) + ")"
_REASON = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(content, {_LITERAL(p)}) THEN {strip(f'regexp_extract(content, {_LITERAL(p)}, 1)')} END" for p in P.PREREQUISITE_REASONS) + ")"
_SERVICE = "CASE " + " ".join(f"WHEN contains(lower(action) || chr(10) || lower(coalesce(command, '')), '{x}') THEN '{x}'" for x in P.CHECKED_SERVICES) + " END"
_STATED = f"""qa AS ({" UNION ALL ".join(f"SELECT session_id, msg_idx, role, content, {i} AS place, unnest({_AS_PAIR(p)}) AS z FROM s WHERE length(content) >= 20 AND {any_of('lower(content)', P.PREREQUISITE_WORDS)}" for i, p in enumerate(P.PREREQUISITE_PATTERNS))}),
  qb AS (SELECT *, {strip("z[1]")} AS a, {strip("z[2]")} AS b FROM qa),
  qc AS (SELECT session_id, msg_idx, role, content, place, lower(CASE WHEN length(a) < length(b) THEN a ELSE b END) AS environment, CASE WHEN length(a) < length(b) THEN b ELSE a END AS action FROM qb WHERE a <> '' AND b <> ''),
  qd AS (SELECT *, {_COMMAND} AS command, {_REASON} AS reason FROM qc WHERE length(action) BETWEEN 5 AND 200 AND length(environment) BETWEEN 2 AND 40
    AND ({any_of("environment", P.ENVIRONMENTS)} OR length(environment) <= 15 OR NOT ((contains(environment, ' ') AND length(environment) > 20) OR {any_of("environment", ["(", ")", "{", "}", "=", ":"])}))
    AND NOT {any_of("lower(action)", P.NO_ACTIONS)} AND {letters("action")} >= 0.7 AND ({any_of("lower(action)", P.ACTION_WORDS)} OR {starts("lower(action)", P.ACTION_STARTS)})),
  qe AS (SELECT *, {_SERVICE} AS service FROM qd),
  qf AS (SELECT *, 0.5::DOUBLE + CASE WHEN role = 'user' THEN 0.15 ELSE 0 END + CASE WHEN command IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN service IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN reason IS NOT NULL THEN 0.05 ELSE 0 END AS confidence FROM qe),
  qg AS (SELECT environment, action, count(*) AS frequency, round(least(1.0, arg_min(confidence, (session_id, msg_idx, place)) + 0.1::DOUBLE * (count(*) - 1)), 4) AS confidence,
         arg_max(command, (session_id, msg_idx, place)) FILTER (WHERE command IS NOT NULL) AS command, arg_max(reason, (session_id, msg_idx, place)) FILTER (WHERE reason IS NOT NULL) AS reason,
         arg_max(service, (session_id, msg_idx, place)) FILTER (WHERE service IS NOT NULL) AS service FROM qf GROUP BY environment, action)"""


@query(f"WITH {SAID}, {_STATED} SELECT environment, action, frequency, confidence, command, reason, service FROM qg")
def prerequisites_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.prerequisites(profile.statements(said(spark, sf_dir))).select("environment", "action", "frequency", "confidence", "command", "reason", "service")


@query(f"""WITH {SAID}, {_STATED} SELECT 'prerequisite' AS type, CASE WHEN confidence > 0.75 THEN 'high' ELSE 'medium' END AS priority, action AS message, environment, CASE WHEN command <> '' THEN 'Run: ' || command END AS suggestion, reason AS context
  FROM qg WHERE confidence >= 0.5 AND (environment IN ('all', 'always', 'any', 'everywhere') OR contains(environment, 'docker') OR contains('docker', environment) OR contains(environment, 'wsl2') OR contains('wsl2', environment))""")
def prerequisite_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.prerequisite_alerts(profile.prerequisites(profile.statements(said(spark, sf_dir))), ["docker", "wsl2"]).drop("confidence", "frequency")


@query(f"""WITH {SAID}, w AS (SELECT session_id, msg_idx, lower(content) AS c, role, CASE WHEN role = 'user' THEN sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY msg_idx) END AS nth FROM s),
  g AS (SELECT session_id, count(nth) AS n, count(*) FILTER (WHERE contains(c, 'edit')) AS edits, string_agg(substr(c, 1, 200), ' ' ORDER BY nth) FILTER (WHERE nth <= 3) AS opening, max(CASE WHEN nth = 1 THEN substr(c, 1, 100) END) AS first_ FROM w GROUP BY session_id HAVING count(nth) >= 3),
  d AS (SELECT session_id, unnest(list_filter([CASE WHEN edits > 3 THEN {_LITERAL(P.WORK_PATTERNS[0])} END, CASE WHEN {any_of("opening", P.EARLY_TESTS)} THEN {_LITERAL(P.WORK_PATTERNS[1])} END,
    CASE WHEN {any_of("opening", P.EARLY_PLANS)} THEN {_LITERAL(P.WORK_PATTERNS[2])} END, CASE WHEN {any_of("first_", P.DIRECT_WORDS)} THEN {_LITERAL(P.WORK_PATTERNS[3])} END], lambda x: x IS NOT NULL)) AS description FROM g)
  SELECT 'workflow' AS pattern_type, description, count(*) AS frequency, 0.5::DOUBLE AS confidence FROM d GROUP BY description""")
def work_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.work_patterns(profile.session_patterns(said(spark, sf_dir)))
    return found.where("pattern_type = 'workflow'").withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH {SAID}, lm AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) - 1 AS pos, content FROM s WHERE role = 'user'), {LIFECYCLE}
  SELECT sequence AS description, count(*) AS frequency, round(list_reduce(list(confidence ORDER BY session_id), lambda a, x: least(1.0::DOUBLE, (a + x) / 2 + 0.05::DOUBLE)), 6) AS confidence FROM lc WHERE confidence >= 0.3 GROUP BY sequence""")
def lifecycle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles with confidences averaged session by session."""
    found = profile.work_patterns(profile.session_patterns(said(spark, sf_dir)))
    return found.where("pattern_type = 'lifecycle'").select("description", "frequency", F.round("confidence", 6).alias("confidence"))


# --- metadata of sessions ---------------------------------------------------------------------------------------------
_FACTS = f"""fa AS ({matches("(SELECT * FROM s WHERE role = 'assistant')", [(p, 1, {"priority": n}) for n, p in P.FACT_PATTERNS])}),
  fb AS (SELECT *, {strip("regexp_replace(found, '\\s+', ' ', 'g')")} AS fact FROM fa WHERE pos <= 3),
  fc AS (SELECT *, lower(substr(fact, 1, 50)) AS key_ FROM fb WHERE length(fact) BETWEEN 20 AND 200 AND NOT {any_of("fact", P.NO_FACT_SIGNS)} AND NOT regexp_matches(fact, {_LITERAL("(?i)" + "|".join(P.NO_FACTS))}) AND NOT {starts("lower(fact)", P.NO_FACT_STARTS)} AND {letters("fact")} >= 0.7),
  fd AS ({_FIRST("fc", "session_id, key_", "msg_idx, place, pos")}),
  fe AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, msg_idx, place, pos) AS rank FROM fd)"""


@query(f"WITH {SAID}, {_FACTS} SELECT session_id, msg_idx, fact, priority::INT AS priority, rank FROM fe WHERE rank <= 10")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.facts(said(spark, sf_dir))


_DONE = f"""aa AS ({matches("(SELECT * FROM s WHERE role = 'assistant')", [(p, 1, {"kind": kind}) for p, kind in P.ACCOMPLISHMENT_PATTERNS])}),
  ab AS (SELECT *, {strip("found")} AS x FROM aa), ac AS (SELECT *, substr(lower(x), 1, 50) AS key_ FROM ab WHERE length(x) BETWEEN 5 AND 100), ad AS ({_FIRST("ac", "session_id, key_", "msg_idx, place, pos")}),
  ae AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx, place, pos) AS rank FROM ad)"""


@query(f"""WITH {SAID}, {_DONE} SELECT session_id, msg_idx, kind, CASE WHEN kind = 'test' AND regexp_full_match(x, '[0-9]+') THEN x || ' tests passed' WHEN kind = 'release' THEN 'Released v' || x WHEN kind = 'commit' THEN x
  ELSE upper(substr(x, 1, 1)) || substr(x, 2) END AS text, rank FROM ae WHERE rank <= 10""")
def accomplishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.accomplishments(said(spark, sf_dir))


_OUTCOMES = f"""oa AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS late FROM s),
  ob AS (SELECT session_id, msg_idx, list_filter(list_transform(string_split(content, '.')[1:3], lambda x: {strip("x")}), lambda x: length(x) > 20 AND length(x) < 200 AND {any_of("lower(x)", P.OUTCOME_SENTENCE_WORDS)})[1] AS outcome
         FROM oa WHERE late <= 10 AND role = 'assistant' AND {any_of("lower(content)", P.OUTCOME_WORDS)}),
  oc AS (SELECT session_id, arg_max(outcome, msg_idx) AS outcome FROM ob WHERE outcome IS NOT NULL GROUP BY session_id)"""


@query(f"WITH {SAID}, {_OUTCOMES} SELECT session_id, outcome FROM oc")
def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.outcomes(said(spark, sf_dir))


@query(f"""WITH {SAID}, {_OUTCOMES}, f AS (SELECT session_id, {strip("arg_min(content, msg_idx) FILTER (WHERE role = 'user')")} AS first_ FROM s GROUP BY session_id),
  g AS (SELECT session_id, first_, CASE WHEN length(first_) <= 100 THEN first_ WHEN length(regexp_extract(substr(first_, 1, 100), '^([\\s\\S]*) [^ ]*$', 1)) > 50 THEN regexp_extract(substr(first_, 1, 100), '^([\\s\\S]*) [^ ]*$', 1) || '...' ELSE substr(first_, 1, 100) || '...' END AS task FROM f)
  SELECT session_id, coalesce(nullif(concat_ws(' | ', CASE WHEN first_ <> '' THEN 'Task: ' || task END, 'Outcome: ' || outcome), ''), 'No summary available') AS summary FROM g LEFT JOIN oc USING (session_id)""")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.metadata(said(spark, sf_dir)).select("session_id", "summary")


@query()
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole metadata of sessions put into one text each; its parts have SQL of their own, the budget a test."""
    return sessions.documents(sessions.metadata(said(spark, sf_dir)).withColumn("git_branch", F.lit("main")))


@query(f"""WITH {SAID}, ca AS ({" UNION ALL ".join(f"SELECT session_id, msg_idx, {i} AS pos, 'technology' AS type, '{t}' AS name, {strip(f'regexp_extract(content, {_LITERAL(rf'(?i)\b{t}\b[^.]*(?:for|to|handles?|provides?|enables?)[^.]*\.')})')} AS description, 0.8::DOUBLE AS confidence FROM s WHERE length(content) >= 20" for i, t in enumerate(P.TECHNOLOGIES))}
    UNION ALL SELECT session_id, msg_idx, 99, 'component', z[1], z[2], 0.75::DOUBLE FROM (SELECT session_id, msg_idx, unnest(list_zip(regexp_extract_all(content, '(?i)(?:The\\s+)?(\\w+\\s+(?:backend|frontend|server|service))\\s+(?:handles?|provides?)\\s+([^.]+)\\.', 1),
      regexp_extract_all(content, '(?i)(?:The\\s+)?(\\w+\\s+(?:backend|frontend|server|service))\\s+(?:handles?|provides?)\\s+([^.]+)\\.', 2))) AS z FROM s WHERE length(content) >= 20))
  SELECT type, name, arg_min(description, (session_id, msg_idx, pos)) AS description, count(*) AS frequency, max(confidence) AS confidence, count(DISTINCT session_id) AS sessions FROM ca WHERE description <> '' AND name <> '' GROUP BY type, name""")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.concepts(said(spark, sf_dir), F.lit("/p")).drop("project_path").withColumn("confidence", F.col("confidence").cast("double"))


_STOP = _ISIN(P.FUZZY_STOPWORDS)


@query(f"""WITH {SAID}, ka AS (SELECT session_id, lower(unnest(regexp_extract_all(content, {_LITERAL(P.FILE_EXTENSION)}, 1))) AS term FROM s UNION ALL SELECT session_id, lower(unnest(regexp_extract_all(content, {_LITERAL(P.ERROR_WORD)}, 1))) FROM s
    UNION ALL SELECT session_id, lower(string_split(unnest(regexp_extract_all(content, {_LITERAL(P.PACKAGE)}, 1)), '/')[1]) FROM s),
  kf AS (SELECT session_id, msg_idx, unnest(regexp_extract_all(content, {_LITERAL(P.FUNCTION_NAME)}, 1)) AS term, generate_subscripts(regexp_extract_all(content, {_LITERAL(P.FUNCTION_NAME)}, 1), 1) AS pos FROM s),
  kg AS (SELECT session_id, lower(term) AS term FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx, pos) AS r FROM kf) WHERE r <= 20 AND length(term) > 2),
  kc AS (SELECT session_id, term, count(*) AS n FROM (SELECT * FROM ka UNION ALL SELECT * FROM kg) GROUP BY session_id, term),
  kw AS (SELECT session_id, unnest(regexp_extract_all(lower(content), '[a-z][a-z0-9_]{{2,}}')) AS term FROM s), kx AS (SELECT session_id, term, count(*) AS n FROM kw WHERE term NOT IN ({_STOP}) GROUP BY session_id, term HAVING count(*) >= 2),
  ky AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS r FROM kx),
  kz AS (SELECT session_id, term, max(n) AS n FROM (SELECT * FROM kc UNION ALL SELECT session_id, term, n FROM ky WHERE r <= 30) GROUP BY session_id, term), kr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS rank FROM kz)
  SELECT session_id, term, n, rank FROM kr WHERE rank <= 50""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.keywords(said(spark, sf_dir))


# --- what a new conversation is told ----------------------------------------------------------------------------------
_KEY = lambda t: f"lower(substr({strip(f'regexp_replace({t}, {_LITERAL(chr(92) + chr(115) + chr(43))}, {_LITERAL(chr(32))}, {_LITERAL(chr(103))})')}, 1, 100))"


@query(f"""WITH {SAID}, g AS (SELECT session_id, msg_idx, content, {_KEY("content")} AS key_ FROM s WHERE role = 'user' AND length({strip("content")}) >= 10 AND NOT ({any_of("lower(content)", P.COMPLETED)} OR contains(lower(content), 'status: completed'))),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(key_, 1, 60) ORDER BY msg_idx) AS again FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS rank FROM o WHERE again = 1)
  SELECT session_id, content AS topic, rank FROM r WHERE rank <= 3""")
def active_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir).where("role = 'user'")
    found = context.active_topics(m.select("session_id", F.col("msg_idx").alias("place"), F.col("content").alias("summary")), "session_id")
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SAID}, g AS (SELECT session_id, msg_idx, content, substr({_KEY("content")}, 1, 60) AS key_ FROM s WHERE length({strip("content")}) >= 15 AND NOT {any_of("lower(content)", P.NO_DECISIONS)} AND regexp_matches(content, '^\\p{{Lu}}') AND regexp_matches(content, '[.!?]\\s*$')
    AND len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) >= 4 AND {letters("content")} >= 0.75),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id, key_ ORDER BY msg_idx) AS again FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS rank FROM o WHERE again = 1) SELECT session_id, content AS fact, rank FROM r WHERE rank <= 5""")
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir).select("session_id", F.col("msg_idx").alias("place"), F.lit(0).alias("at"), F.col("content").alias("fact"))
    return context.recent_decisions(m, "session_id").withColumn("rank", F.col("rank").cast("long"))


@query()
def recent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tasks of a session in the order of a greedy fold; tested against a plain one."""
    m = said(spark, sf_dir).where("role = 'user'").select("session_id", F.col("msg_idx").alias("place"), C.clean_task(F.col("content")).alias("task_description"))
    return context.recent_tasks(m, "session_id")


@query(f"WITH {SAID} SELECT event_id, CASE WHEN length(content) > 100 THEN substr(content, 1, 97) || '...' ELSE content END AS shown FROM s WHERE length(content) >= 10 AND NOT {any_of('lower(content)', P.META_TASKS)} AND NOT starts_with(content, '/')")
def tasks_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.shown_tasks(said(spark, sf_dir), "content").select("event_id", "shown")


_SUMMARY = "CASE WHEN contains(text, '|') THEN text ELSE 'Task: ' || text END"


@query(rf"""WITH d AS (SELECT doc_id, text, n_chars, substr('Task: ' || text, 7) AS plain, 'Task: ' || text AS summary FROM documents WHERE text IS NOT NULL), t AS (SELECT * FROM d ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 200),
  p AS (SELECT doc_id, n_chars, summary, CASE WHEN contains(summary, '|') THEN {strip("list_last(string_split(summary, '|'))")} ELSE {strip("plain")} END AS plain FROM t)
  SELECT doc_id, substr(plain, 1, 200) AS summary FROM p WHERE length(summary) >= 20 AND NOT {any_of("lower(summary)", P.META_QUESTIONS)} AND length(plain) >= 30 AND regexp_matches(plain, '^\p{{L}}') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 1""")
def last_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("session_id"), F.col("n_chars").alias("last_modified"), F.concat(F.lit("Task: "), "text").alias("summary"), F.lit("").alias("task_description"))
    return context.last_session(d, 200).select(F.col("session_id").alias("doc_id"), "summary")


@query(f"WITH {SAID}, {_ALL_RULES}, f AS (SELECT rule_type, rule_text, min((session_id, msg_idx, place)) AS place FROM rc GROUP BY rule_type, rule_text), i AS (SELECT *, row_number() OVER (PARTITION BY rule_type ORDER BY place, rule_text) AS i FROM f), " + """
  o AS (SELECT *, list_position(['never', 'always', 'require', 'prefer', 'avoid', 'prohibit', 'style'], rule_type) AS o FROM i WHERE i <= 2 AND length(rule_text) BETWEEN 10 AND 80), r AS (SELECT *, row_number() OVER (ORDER BY o, i) AS rank FROM o)
  SELECT rule_type, CASE rule_type """ + " ".join(f"WHEN '{k}' THEN {_LITERAL(v)}" for k, v in P.RULE_NAMES.items()) + """ END || ': ' || rule_text AS tip, rank FROM r WHERE rank <= 6""")
def rule_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.rules(said(spark, sf_dir)).groupBy("rule_type", "rule_text").agg(F.min(F.struct("session_id", "msg_idx", "at")).alias("p")).withColumn("place", F.struct("p.session_id", "p.msg_idx", "p.at", "rule_text"))
    return context.rule_tips(r).withColumn("rank", F.col("rank").cast("long"))


# --- history ----------------------------------------------------------------------------------------------------------
@query(f"WITH {OPERATIONS}, w AS (SELECT event_id, session_id, file_path, ts, unnest(string_split('def f' || (event_id % 5) || '(x):' || chr(10) || content || chr(10) || 'class K' || (event_id % 3) || ':', chr(10))) AS text, generate_subscripts(string_split('x' || chr(10) || content || chr(10) || 'y', chr(10)), 1) AS line FROM o WHERE op = 'write')" + r"""
  SELECT event_id, session_id, file_path, CASE WHEN starts_with(text, 'def') THEN 'function' ELSE 'class' END AS symbol_type, regexp_extract(text, '^(?:def|class) (\w+)', 1) AS symbol_name, line AS line_number FROM w WHERE regexp_matches(text, '^(?:def|class) \w+')""")
def symbol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    text = F.concat(F.lit("def f"), (F.col("event_id") % 5).cast("string"), F.lit("(x):\n"), "content", F.lit("\nclass K"), (F.col("event_id") % 3).cast("string"), F.lit(":"))
    return history.symbol_history(ops.withColumn("content", text)).select("event_id", "session_id", "file_path", "symbol_type", "symbol_name", "line_number")


@query(f"WITH {OPERATIONS} SELECT count(*) AS total_operations, count(*) FILTER (WHERE op = 'write') AS snapshots, count(*) FILTER (WHERE op = 'edit') AS edits, count(DISTINCT file_path) AS unique_files FROM o")
def code_history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.totals(operations(spark, sf_dir))


@query(f"WITH {OPERATIONS} SELECT file_path, epoch_us(max(ts)) AS last_us FROM o GROUP BY file_path ORDER BY max(ts) DESC, file_path LIMIT 15")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_files(operations(spark, sf_dir)).select("file_path", F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH {OPERATIONS} SELECT event_id, file_path, substr(coalesce(old_string, ''), 1, 4) AS before, substr(coalesce(new_string, ''), 1, 4) AS after, coalesce(length(old_string) > 4, false) AS before_truncated, coalesce(length(new_string) > 4, false) AS after_truncated FROM o WHERE op = 'edit' ORDER BY ts DESC, event_id DESC LIMIT 20")
def changes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.shown_changes(operations(spark, sf_dir), 20, 4).drop("ts")


@query(f"WITH {OPERATIONS} SELECT 'total' AS section, 'operations' AS name, count(*) AS n FROM o UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM o UNION ALL SELECT 'by_type', op, count(*) FROM o GROUP BY op UNION ALL SELECT * FROM (SELECT 'top_files', file_path, count(*) FROM o GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 10)")
def operation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.operation_stats(operations(spark, sf_dir))
