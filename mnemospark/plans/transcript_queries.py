"""Registered queries: parsed transcript lines, what is to be ingested, merges of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import extract, fuzzy, profile, sessions, stats, upsert, vectors
from mnemospark.plans.profile_queries import _ALL_DECISIONS, _ALL_ERRORS, _NAMES
from mnemospark.plans.registry import EVENTS, LINES, SAID, query
from mnemospark.sources import transcripts
from mnemospark.sources.tables import events, lines, said, table


@query(f"WITH {LINES}, m AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS msg_idx, CASE event_type WHEN 'error' THEN 'user' ELSE 'assistant' END AS role, CASE event_type WHEN 'error' THEN 'failed with code ' || k ELSE 'edit ' || k || chr(10) || 'bare ' || k END AS content, epoch_us(ts) AS us FROM l WHERE event_type IN ('error', 'click')) SELECT * FROM m")
def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.messages(lines(spark, sf_dir)).select("session_id", "msg_idx", "role", "content", F.unix_micros("ts").alias("us"))


@query(f"""WITH {LINES} SELECT session_id, project, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS message_count, 'seen ' || arg_max(event_id, line) FILTER (WHERE event_type = 'view') AS summary, 'failed with code ' || arg_min(k, line) FILTER (WHERE event_type = 'error') AS first_user_message,
  'b' || (arg_min(k, line) FILTER (WHERE event_type = 'error') % 3) AS git_branch, array_to_string(list_sort(list_distinct(list('m' || (k % 2)) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')))), ',') AS models FROM l GROUP BY session_id, project""")
def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transcripts.sessions(lines(spark, sf_dir))
    return s.select("session_id", "project", "message_count", "summary", "first_user_message", "git_branch", F.array_join("models_used", ",").alias("models"))


@query(f"""WITH {LINES}, t AS (SELECT session_id, unnest(CASE event_type WHEN 'click' THEN ['Edit'] WHEN 'purchase' THEN ['Write'] WHEN 'signup' THEN ['Glob', 'TodoWrite'] ELSE [] END) AS tool, path FROM l), c AS (SELECT session_id, tool, count(*) AS n FROM t GROUP BY session_id, tool)
  SELECT session_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools, (SELECT string_agg(DISTINCT path, ',' ORDER BY path) FROM t x WHERE x.session_id = c.session_id) AS files FROM c GROUP BY session_id""")
def transcript_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = transcripts.tool_usage(lines(spark, sf_dir))
    pairs = F.array_sort(F.transform(F.map_entries("tools_used"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return used.select("session_id", F.array_join(pairs, ",").alias("tools"), F.array_join("files_touched", ",").alias("files"))


@query(f"WITH {LINES} SELECT session_id, line, 0 AS place, 'task ' || k AS task, 'done' AS status FROM l WHERE event_type = 'signup' UNION ALL SELECT session_id, line, 1, 'task ' || (k + 1), 'pending' FROM l WHERE event_type = 'signup'")
def transcript_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.todos(lines(spark, sf_dir)).select("session_id", "line", F.col("place").cast("int").alias("place"), "task", "status")


@query(f"WITH {LINES} SELECT session_id, array_to_string(list_sort(list_distinct(flatten(list(['task ' || k, 'task ' || (k + 1)]))))[1:20], ',') AS topics FROM l WHERE event_type = 'signup' GROUP BY session_id")
def todo_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts.todos(lines(spark, sf_dir))
    found = sessions.metadata(transcripts.messages(lines(spark, sf_dir)), todos=t).where(F.size("todo_topics") > 0)
    return found.select("session_id", F.array_join("todo_topics", ",").alias("topics"))


@query(f"WITH {LINES} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS seq, CASE event_type WHEN 'click' THEN 'edit' ELSE 'write' END AS op, path AS file_path, CASE WHEN event_type = 'purchase' THEN 'c' || k END AS content, CASE WHEN event_type = 'click' THEN 'a' || k END AS old_string, CASE WHEN event_type = 'click' THEN 'b' END AS new_string, false AS replace_all FROM l WHERE event_type IN ('click', 'purchase')")
def transcript_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.file_operations(lines(spark, sf_dir)).drop("ts")


@query(f"WITH {EVENTS}, f AS (SELECT user_id, max(ts) AS m FROM e GROUP BY user_id), d AS (SELECT user_id, max(ts) AS m FROM e WHERE event_id % 2 = 0 GROUP BY user_id) SELECT f.user_id AS session_id FROM f LEFT JOIN d ON f.user_id = d.user_id WHERE f.user_id % 5 <> 0 AND (d.m IS NULL OR d.m <> f.m)")
def files_to_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    files = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_modified")).withColumn("is_agent", F.col("session_id") % 5 == 0)
    done = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_modified"))
    return transcripts.changed(files, done).select("session_id")


@query(f"WITH {SAID}, {_ALL_ERRORS}, {_ALL_DECISIONS} SELECT (SELECT count(*) FROM es) AS errors, (SELECT count(solution) FROM es) AS solved, (SELECT count(*) FROM de) AS decisions")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.insights(said(spark, sf_dir))


@query("""WITH p AS (SELECT user_id AS session_id, '/p' || (user_id % 3) AS project_path FROM events GROUP BY user_id), a AS (SELECT user_id AS session_id, event_type AS artifact_type FROM events)
  SELECT project_path, artifact_type, count(*) AS n FROM a JOIN p USING (session_id) GROUP BY ALL UNION ALL SELECT NULL, artifact_type, count(*) FROM a GROUP BY artifact_type""")
def artifacts_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("artifact_type"))
    p = e.select("session_id").distinct().withColumn("project_path", F.concat(F.lit("/p"), (F.col("session_id") % 3).cast("string")))
    return stats.by_project(e, p).select("project_path", "artifact_type", "n")


@query("""WITH s AS (SELECT c_custkey AS session_id, c_nationkey AS project_id, c_acctbal FROM customer) SELECT session_id, n_name AS project, round(c_acctbal::DOUBLE, 2) AS balance FROM s JOIN nation ON project_id = n_nationkey ORDER BY c_acctbal DESC, session_id LIMIT 50""")
def sessions_with_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions joined with the dimension of projects, of which there are few; the largest first."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("project_id"), "c_acctbal")
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))
    return s.join(p, "project_id").orderBy(F.desc("c_acctbal"), "session_id").limit(50).select("session_id", "project", F.round(F.col("c_acctbal").cast("double"), 2).alias("balance"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [p_name, p_type] END, '|') AS items FROM part")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("no list [")).otherwise(F.to_json(F.array("p_name", "p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.json_list(text), "|").alias("items"))


@query(f"""WITH {SAID}, {_NAMES}, o AS (SELECT * FROM nd WHERE session_id % 2 = 0), n AS (SELECT session_id, name, 'call_me' AS pattern, 0.5::DOUBLE AS confidence FROM nd WHERE session_id % 3 = 0)
  SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.name, n.name) AS name, coalesce(n.pattern, o.pattern) AS pattern, greatest(o.confidence, n.confidence) AS confidence FROM o FULL JOIN n ON o.session_id = n.session_id AND o.name = n.name""")
def names_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.name_candidates(said(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))
    new = c.where("session_id % 3 = 0").withColumns({"pattern": F.lit("call_me"), "confidence": F.lit(0.5)})
    return upsert.merge(c.where("session_id % 2 = 0"), new, ["session_id", "name"], upsert.NAMES)


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'host/' || p_brand END AS git_remote, '/home/' || p_partkey AS path, p_size AS created_at FROM part)
  SELECT coalesce(git_remote, path) AS project_key, min(path) AS path, max(git_remote) AS git_remote, min(created_at) AS created_at FROM p GROUP BY 1""")
def projects_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("https://host/"), "p_brand", F.lit(".git")))
    p = table(spark, sf_dir, "part").select(remote.alias("git_remote"), F.concat(F.lit("/home/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("created_at"))
    return upsert.projects(p)


@query("""WITH o AS (SELECT doc_id AS session_id, sha256(text || 'x') AS content_hash FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS session_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)
  SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(n.content_hash, o.content_hash) AS content_hash FROM o FULL JOIN n ON o.session_id = n.session_id""")
def archives_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("session_id"), F.sha2(F.concat("text", F.lit("x")), 256).alias("content_hash"))
    new = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("session_id"), F.sha2("text", 256).alias("content_hash"))
    return upsert.coalesce_merge(old, new, ["session_id"])


@query(f"WITH {EVENTS}, k AS (SELECT DISTINCT event_id % 40 AS version FROM e), a AS (SELECT event_id % 20 AS version, bool_or(event_id % 7 = 0) AS success FROM e WHERE event_id % 20 < 12 GROUP BY 1) SELECT (SELECT max(version) FROM a WHERE success) AS current, (SELECT count(*) FROM a WHERE success) AS applied, (SELECT count(*) FROM k WHERE version NOT IN (SELECT version FROM a WHERE success)) AS pending")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    known = e.select((F.col("event_id") % 40).alias("version")).distinct()
    applied = e.where("event_id % 20 < 12").groupBy((F.col("event_id") % 20).alias("version")).agg(F.bool_or(F.col("event_id") % 7 == 0).alias("success"))
    return stats.versions(known, applied)


@query("SELECT vec_id, label::BIGINT AS session_id FROM embeddings WHERE label IN (SELECT DISTINCT user_id % 7 FROM events WHERE user_id % 7 < 4)")
def vectors_of_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("session_id"))
    indexed = events(spark, sf_dir).where("user_id % 7 < 4").select((F.col("user_id") % 7).alias("session_id")).distinct()
    return vectors.of_indexed(v, indexed)


@query()
def session_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the sessions' keywords, summaries and tasks; the metadata and the vocabulary have SQL of their own."""
    return fuzzy.session_vocabulary(sessions.metadata(said(spark, sf_dir))).select("term", "frequency", F.array_join("sources", ",").alias("sources"))
