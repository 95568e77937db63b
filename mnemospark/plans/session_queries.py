"""Registered queries: sessions, status, upserts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import gates as G
from mnemospark.functions import patterns as P
from mnemospark.operators import sessions, stats, upsert
from mnemospark.plans.registry import EVENTS, OPERATIONS, SAID, TURNS, any_of, query
from mnemospark.sources.tables import events, operations, said, table, turns
from mnemospark.streaming import queries as streams

_STOP = ", ".join(f"'{w}'" for w in P.FUZZY_STOPWORDS)


@query(f"""WITH {TURNS} SELECT session_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS user_messages,
  arg_min(content, msg_idx) FILTER (WHERE role = 'user') AS first_user_message, arg_max(content, msg_idx) FILTER (WHERE role = 'assistant') AS last_assistant_message,
  CAST(epoch(min(ts)) AS BIGINT) AS started_at, CAST(epoch(max(ts)) AS BIGINT) AS ended_at FROM t GROUP BY session_id""")
def sessions_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rollup(turns(spark, sf_dir)).withColumns({"started_at": F.unix_seconds("started_at"), "ended_at": F.unix_seconds("ended_at")})


_SESSIONS = "s AS (SELECT user_id AS session_id, '/p' || (user_id % 10) AS project_path, min(ts) AS started_at, count(*) AS message_count FROM e GROUP BY user_id)"


def _project_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"), F.count("*").alias("message_count"))
    return e.withColumn("project_path", F.concat(F.lit("/p"), (F.col("session_id") % 10).cast("string")))


@query(f"WITH {EVENTS}, {_SESSIONS} SELECT session_id, project_path, epoch_us(started_at) AS started_us, message_count FROM s ORDER BY started_at DESC NULLS LAST, session_id LIMIT 10")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.recent(_project_sessions(spark, sf_dir))
    return found.select("session_id", "project_path", F.unix_micros("started_at").alias("started_us"), "message_count")


@query(f"WITH {EVENTS}, {_SESSIONS} SELECT project_path, count(*) AS n_sessions, epoch_us(max(started_at)) AS latest_us, arg_max(session_id, (started_at, session_id)) AS newest FROM s GROUP BY project_path")
def recent_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sessions.group_by_project(_project_sessions(spark, sf_dir))
    return g.select("project_path", F.col("n_sessions").cast("long").alias("n_sessions"), F.unix_micros("latest").alias("latest_us"), F.element_at("sessions", 1)["session_id"].alias("newest"))


_SHIFTS = f"""sa AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY msg_idx))) / 1e6 AS gap FROM s),
  sb AS (SELECT *, role = 'user' AND ({any_of("substr(lower(content), 1, 500)", P.TOPIC_SHIFTS)} OR coalesce(gap > 7200, false)) AS shift FROM sa)"""


@query(f"WITH {SAID}, {_SHIFTS} SELECT session_id, msg_idx, round(gap, 3) AS gap_seconds FROM sb WHERE shift")
def topic_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.topic_shifts(said(spark, sf_dir))


_GAPS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)"""


@query(f"WITH {EVENTS}, {_GAPS} SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY user_id, i")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.gap_sessions(events(spark, sf_dir), "user_id", "ts")
    return found.select("user_id", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


#: A message an hour and a half of each user, so that only phrases and the jumps of every 40th shift the topic.
_HOURLY = f"""{EVENTS}, h AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS msg_idx, event_id FROM e),
  s AS (SELECT session_id, msg_idx, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, to_timestamp(1704067200 + msg_idx * 5400 + (msg_idx // 40) * 9000) AT TIME ZONE 'UTC' AS ts, CASE WHEN event_id % 50 = 0 THEN 'Back to it' ELSE 'x' END AS content FROM h)"""


@query(f"""WITH {_HOURLY}, {_SHIFTS}, sc AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, max(shift::INT) OVER (PARTITION BY session_id ORDER BY msg_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM sb),
  sd AS (SELECT *, msg_idx < 5 OR msg_idx >= n - 10 OR near = 1 AS kept FROM sc),
  se AS (SELECT *, count(*) FILTER (WHERE NOT kept) OVER (PARTITION BY session_id) AS others, count(*) FILTER (WHERE NOT kept) OVER (PARTITION BY session_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING) - 1 AS other FROM sd)
  SELECT session_id, msg_idx FROM se WHERE n <= 30 OR kept OR other % greatest(1, others // 20) = 0""")
def sampled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    m = e.select(F.col("user_id").alias("session_id"), place.alias("msg_idx"), "event_id")
    role, content = F.when(F.col("event_id") % 3 == 0, "user").otherwise("assistant"), F.when(F.col("event_id") % 50 == 0, "Back to it").otherwise("x")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("msg_idx") * 5400 + F.floor(F.col("msg_idx") / 40) * 9000)
    return sessions.sampled(m.select("session_id", "msg_idx", role.alias("role"), at.alias("ts"), content.alias("content")))


@query(f"""WITH {TURNS}, w AS (SELECT session_id, unnest(regexp_extract_all(lower(content), '[a-z][a-z0-9_]{{2,}}')) AS term FROM t),
  c AS (SELECT session_id, term, count(*) AS n FROM w WHERE term NOT IN ({_STOP}) GROUP BY session_id, term HAVING count(*) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS rank FROM c) SELECT session_id, term, n, rank FROM r WHERE rank <= 30""")
def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.keyword_counts(turns(spark, sf_dir))


_BUCKETS = "b AS (SELECT session_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n FROM t GROUP BY session_id), g AS (SELECT CASE WHEN n = 0 THEN 'no_messages' WHEN n <= 2 THEN 'minimal' ELSE 'sessions' END AS bucket, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_messages FROM b GROUP BY 1)"


@query(f"WITH {TURNS}, {_BUCKETS} SELECT * FROM g")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_buckets(turns(spark, sf_dir))


@query(f"""WITH {TURNS}, {_BUCKETS}, x AS (SELECT CAST(coalesce(sum(n_sessions) FILTER (WHERE bucket = 'sessions'), 0) AS BIGINT) AS total FROM g),
  y AS (SELECT total, least(25, total) AS indexed FROM x) SELECT total, indexed, greatest(0, total - indexed) AS pending, CASE WHEN total > 0 THEN round(100.0::DOUBLE * indexed / total, 1) ELSE 100.0 END AS percent, indexed >= total AS complete FROM y""")
def status_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.progress(stats.size_buckets(turns(spark, sf_dir)), F.lit(25).cast("long"))
    return out.withColumn("pending", F.col("pending").cast("long"))


@query(f"WITH {EVENTS} SELECT event_id FROM (SELECT *, k % 5 AS attempts FROM e) WHERE attempts < 3 ORDER BY ts, event_id LIMIT 20")
def queue_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = events(spark, sf_dir).select("event_id", F.col("event_id").alias("item"), F.col("ts").alias("queued_at"), (F.col("k") % 5).alias("attempts"))
    return upsert.next_in_queue(q, 20).select("event_id")


@query("""SELECT coalesce(source, 'unknown') AS source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY 1""")
def stats_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return d.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return stats.counts(d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "lang")


@query("SELECT count(*) AS archives, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_bytes, round(coalesce(avg(coalesce(strlen(text), 0)), 0), 4) AS avg_bytes FROM documents")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.archive_stats(table(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, strlen(coalesce(text, '')) AS size_bytes, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS line_count FROM documents")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text, 256).alias("content_hash"), F.octet_length(text).cast("long").alias("size_bytes"), C.line_count(text).cast("long").alias("line_count"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, max(event_type) AS kind, CAST(NULL AS VARCHAR) AS note, count(*) AS n FROM e WHERE event_id % 2 = 0 GROUP BY user_id),
  w AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE min(event_type) END AS kind, 'seen' AS note, count(*) AS n FROM e WHERE event_id % 2 = 1 GROUP BY user_id)
  SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(w.kind, o.kind) AS kind, coalesce(w.note, o.note) AS note, CASE WHEN w.user_id IS NOT NULL THEN w.n ELSE o.n END AS n FROM o FULL JOIN w ON o.user_id = w.user_id""")
def dedup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_type").alias("kind"), F.lit(None).cast("string").alias("note"), F.count("*").alias("n"))
    kind = F.when(F.col("user_id") % 3 != 0, F.min("event_type"))
    new = e.where("event_id % 2 = 1").groupBy("user_id").agg(kind.alias("kind"), F.lit("seen").alias("note"), F.count("*").alias("n"))
    return upsert.coalesce_merge(old, new, ["user_id"], overwrite=["n"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("""WITH p AS (SELECT p_partkey, list_distinct([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS b FROM part),
  r AS (SELECT list_distinct([substr('small ring gadget', i, 2) FOR i IN range(1, length('small ring gadget'))]) AS b)
  SELECT p_partkey, round(len(list_intersect(p.b, r.b)) / (len(p.b) + len(r.b) - len(list_intersect(p.b, r.b)))::DOUBLE, 4) AS similarity FROM p, r""")
def task_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.jaccard(C.bigrams(F.col("p_name")), C.bigrams(F.lit("small ring gadget"))), 4).alias("similarity"))


@query(f"WITH {EVENTS} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.tumbling(streams.event_stream(spark, sf_dir)), streams.folder(spark), "update", ["window_start", "event_type"])
    return out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", "ids")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.deduplicated(streams.event_stream(spark, sf_dir, "40 days").select("user_id", "event_type", "ts"), ["user_id", "event_type"])
    return streams.run_available(s, streams.folder(spark)).select("user_id", "event_type")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.running_counts(streams.event_stream(spark, sf_dir).select("user_id", "event_id"))
    return streams.run_available(s, streams.folder(spark), "update", ["user_id"])


@query(f"WITH {OPERATIONS} SELECT session_id, op, count(*) AS n, count(DISTINCT file_path) AS files FROM o GROUP BY 1, 2")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(spark, sf_dir).groupBy("session_id", "op").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query(f"WITH {EVENTS}, w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM e) SELECT epoch_us(w) AS window_us, count(*) AS n FROM w GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.sliding(streams.event_stream(spark, sf_dir)), streams.folder(spark), "update", ["window_start"])
    return out.select(F.unix_micros("window_start").alias("window_us"), "n")


@query(f"WITH {EVENTS}, {_GAPS} SELECT user_id, count(*) AS changes, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY user_id, i")
def stream_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes with two hours of quiet between, as a stream."""
    out = streams.run_available(streams.settled(streams.event_stream(spark, sf_dir), "user_id", quiet="2 hours"), streams.folder(spark), "complete")
    return out.select("user_id", "changes", F.unix_micros("first_change").alias("first_us"), F.unix_micros("last_change").alias("last_us"))


@query("SELECT user_id AS session_id, event_id AS msg_idx FROM events")
def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read twice over, of which state lets each pass once."""
    e = streams.event_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_idx"))
    return streams.run_available(streams.fresh(e.union(e)), streams.folder(spark))


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS changes FROM e GROUP BY user_id")
def stream_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.waiting(streams.event_stream(spark, sf_dir, "40 days"), "user_id"), streams.folder(spark), "update")
    return out.groupBy("user_id").agg(F.max("changes").alias("changes"))


@query(f"WITH {EVENTS}, {_SESSIONS} SELECT project_path AS project, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, project LIMIT 5")
def files_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.files_per_project(_project_sessions(spark, sf_dir).withColumnRenamed("project_path", "project"))


@query(f"""WITH {TURNS}, b AS (SELECT session_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n FROM t GROUP BY session_id)
  SELECT CASE WHEN n = 0 THEN 'no_messages' WHEN n <= 2 THEN 'minimal' WHEN session_id % 3 = 0 THEN 'agents' ELSE 'sessions' END AS bucket, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_messages FROM b GROUP BY 1""")
def status_buckets_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return stats.size_buckets(t, t.where("session_id % 3 = 0").select("session_id").distinct())


_ITEMS = "q AS (SELECT event_id AS item, ts AS updated_at, CASE WHEN k % 7 = 0 THEN 'done' ELSE 'pending' END AS status, k % 4 AS attempts FROM e)"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(F.col("event_id").alias("item"), F.col("ts").alias("updated_at"), F.when(k % 7 == 0, "done").otherwise("pending").alias("status"), (k % 4).alias("attempts"))


@query(f"""WITH {EVENTS}, {_ITEMS} SELECT item, CASE WHEN item % 5 = 0 THEN 'done' WHEN item % 5 = 1 AND attempts + 1 >= 3 THEN 'failed' ELSE status END AS status, attempts + CASE WHEN item % 5 = 1 THEN 1 ELSE 0 END AS attempts FROM q""")
def queue_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    return upsert.finished(q, q.where("item % 5 = 0"), q.where("item % 5 = 1")).select("item", "status", "attempts")


@query(f"WITH {EVENTS}, {_ITEMS} SELECT item FROM q WHERE NOT (status = 'done' AND updated_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY)")
def queue_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.swept(_queue(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")).select("item")


@query(f"WITH {EVENTS}, {_ITEMS} SELECT status, count(*) AS n FROM q GROUP BY status")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcomes(_queue(spark, sf_dir), "status")


@query("SELECT doc_id, text || '!' AS text, 0::BIGINT AS old FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    old = d.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"), F.lit(0).cast("long").alias("old"))
    return upsert.insert_ignore(old, d.union(d).withColumn("old", F.lit(1).cast("long")), ["doc_id"])


@query("""WITH o AS (SELECT l_partkey AS key_, count(*) AS frequency, max(l_discount)::DOUBLE AS confidence, max(l_shipdate) AS last_seen FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT l_partkey AS key_, count(*) AS frequency, max(l_discount)::DOUBLE AS confidence, max(l_shipdate) AS last_seen FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
  SELECT key_, coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, greatest(o.confidence, n.confidence) AS confidence, strftime(greatest(o.last_seen, n.last_seen), '%Y-%m-%d') AS last_seen FROM o FULL JOIN n USING (key_)""")
def accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    one = lambda rows: rows.groupBy(F.col("l_partkey").alias("key_")).agg(F.count("*").alias("frequency"), F.max("l_discount").cast("double").alias("confidence"), F.max("l_shipdate").alias("last_seen"))
    out = upsert.merge(one(line.where("l_orderkey % 2 = 0")), one(line.where("l_orderkey % 2 = 1")), ["key_"], {"frequency": "sum", "confidence": "max", "last_seen": "max"})
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query("SELECT p_partkey, regexp_replace(regexp_replace('git@host.org:' || p_brand || '/Repo' || p_size || '.git', '\\.git$', ''), '^git@([^:]*):', '\\1/') AS remote FROM part")
def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("git@host.org:"), "p_brand", F.lit("/Repo"), F.col("p_size").cast("string"), F.lit(".git"))
    return table(spark, sf_dir, "part").select("p_partkey", C.normalise_remote(url).alias("remote"))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN format('{:.1f} B', b::DOUBLE) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576.0::DOUBLE) WHEN b < 1099511627776 THEN format('{:.1f} GB', b / 1073741824.0::DOUBLE) ELSE format('{:.1f} TB', b / 1099511627776.0::DOUBLE) END AS shown FROM (SELECT p_partkey, p_size::BIGINT * p_size * p_partkey AS b FROM part)")
def sizes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_size").cast("long") * F.col("p_size") * F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", G.shown_bytes(b).alias("shown"))
