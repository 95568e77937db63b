"""Registered queries: search, ranking, vectors, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.functions import stemming
from mnemospark.operators import fuzzy, search, vectors
from mnemospark.plans.registry import AS_OF, EVENTS, TURNS, query, strip
from mnemospark.sources.tables import events, table, turns

TERMS = ["with", "avec", "der"]


def _as_of():
    return F.lit("2024-12-31 00:00:00").cast("timestamp")



_BM25_OF = """
  tok AS (SELECT conv_id, flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM conversations GROUP BY conv_id),
  d AS (SELECT conv_id, len(w) AS dl, w FROM tok),
  n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
  q AS (SELECT unnest([TERMS]) AS term),
  p AS (SELECT conv_id, dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q),
  f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
  s AS (SELECT conv_id, sum(greatest(1e-6, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score,
        count(*) FILTER (WHERE tf > 0) AS hits FROM p JOIN f USING (term), n GROUP BY conv_id)"""
_BM25 = _BM25_OF.replace("TERMS", "'with', 'avec', 'der'")


@query("WITH" + _BM25 + " SELECT conv_id, round(score, 4) AS score FROM s WHERE hits > 0")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"), TERMS).select("conv_id", F.round("score", 4).alias("score"))


@query("WITH" + _BM25_OF.replace("TERMS", "'the', 'with', 'from'") + " SELECT conv_id, round(score, 4) AS score FROM s WHERE hits = 3")
def search_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"), ["the", "with", "from"], all_terms=True).select("conv_id", F.round("score", 4).alias("score"))


@query(f"WITH {EVENTS} SELECT event_id, round(greatest(0.1, least(1.0, exp(-ln(2.0) / 90 * (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6))), 3) AS decay_factor, round(value * greatest(0.1, least(1.0, exp(-ln(2.0) / 90 * (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6))), 4) AS decayed_score FROM e ORDER BY value * greatest(0.1, least(1.0, exp(-ln(2.0) / 90 * (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6))) DESC, event_id LIMIT 100")
def search_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("exact", F.col("value") * C.decay(F.col("ts"), _as_of()))
    return search.with_decay(e, "value", "ts", _as_of()).orderBy(F.desc("exact"), "event_id").limit(100).select("event_id", "decay_factor", "decayed_score")


@query(f"WITH {EVENTS} SELECT event_id FROM e WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def recent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(events(spark, sf_dir), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 7).select("event_id")


@query("WITH" + _BM25 + " SELECT conv_id, round(score, 4) AS score FROM s WHERE hits > 0 ORDER BY round(s.score, 9) DESC, conv_id LIMIT 25")
def search_keyword_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_top(table(spark, sf_dir, "conversations"), "conv_id", ["text"], "with OR avec OR der", 25).select("conv_id", F.round("score", 4).alias("score"))


_STEMMED = _BM25_OF.replace("regexp_extract_all(lower(text), '[a-z0-9]+')", f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({', '.join(repr(w) for w in P.SEARCH_STOPWORDS)}))")
_STEMMED = _STEMMED.replace("lambda x: x = term", f"lambda x: starts_with(x, term[:-3]) AND ({stemming.stem_sql('x')}) = term")


@query("WITH" + _STEMMED.replace("TERMS", "'thtion', 'threedin'") + " SELECT conv_id, round(score, 4) AS score FROM s WHERE hits > 0 ORDER BY round(s.score, 9) DESC, conv_id LIMIT 25")
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_top(table(spark, sf_dir, "conversations"), "conv_id", ["text"], "thtions OR threedin", 25, stems=True).select("conv_id", F.round("score", 4).alias("score"))


_STOPPED = ", ".join(repr(w) for w in stemming.ENGLISH_STOPWORDS)
_HITS = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM documents),
  c AS (SELECT * FROM w WHERE regexp_matches(word, '^(BEGINNINGS)') AND word NOT IN (""" + _STOPPED + f""")),
  h AS (SELECT doc_id, pos, {stemming.stem_sql('word')} AS term FROM c),
  k AS (SELECT * FROM h WHERE term IN (TERMS))"""


@query("WITH " + _HITS.replace("BEGINNINGS", "o|e").replace("TERMS", "'one', 'ere'") + """, pairs AS (
    SELECT a.doc_id, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp((b.pos - a.pos) / 1.5::DOUBLE - 2))))) AS left_over FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 100 AND a.term <> b.term GROUP BY a.doc_id),
  r AS (SELECT doc_id, 1 - exp(coalesce(left_over, 0)) AS rank FROM (SELECT doc_id FROM k GROUP BY doc_id HAVING count(DISTINCT term) = 2) JOIN pairs USING (doc_id))
  SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY round(r.rank, 9) DESC, doc_id LIMIT 30""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], "ered the oning", 30).select("doc_id", F.round("rank", 6).alias("rank"))


@query("WITH " + _HITS.replace("BEGINNINGS", "o").replace("TERMS", "'one'") + """, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM k), r AS (SELECT doc_id, 0.1::DOUBLE * sum(1::DOUBLE / (j * j)) / 1.64493406685::DOUBLE AS rank FROM n GROUP BY doc_id)
  SELECT doc_id, round(rank, 6) AS rank FROM r""")
def search_ranked_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], "onedly").select("doc_id", F.round("rank", 6).alias("rank"))


_NEAREST = """v AS (SELECT label AS session_id, max(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))) AS score FROM embeddings GROUP BY label ORDER BY score DESC, session_id LIMIT 10)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    first = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    top = search.vector_top(v.crossJoin(F.broadcast(first)), F.col("q"), "label", "vec_id", "embedding")  # one query row
    return top.select(F.col("session_id").cast("long").alias("session_id"), "score")


@query("WITH" + _BM25 + f""", {_NEAREST},
  k AS (SELECT conv_id AS session_id, score FROM s WHERE hits > 0),
  m AS (SELECT session_id::BIGINT AS session_id, score, 'vector' AS search_source FROM v UNION ALL SELECT session_id, score, 'keyword' FROM k WHERE session_id NOT IN (SELECT session_id FROM v))
  SELECT session_id, round(score, 4) AS score, search_source FROM m ORDER BY round(m.score, 9) DESC, session_id LIMIT 30""")
def search_hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = search.bm25(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"), TERMS).withColumnRenamed("conv_id", "session_id")
    return search.merge_hybrid(_nearest(spark, sf_dir), k, limit=30).select("session_id", F.round("score", 4).alias("score"), "search_source")


_PLACES = lambda text, q, rows, key: f"""pl AS (SELECT {key}, {text} AS c, string_split(lower({text}), '{q}') AS parts FROM {rows} WHERE contains(lower({text}), '{q}')),
  pi AS (SELECT {key}, c, unnest(range(1, least(len(parts), 4))) AS i, parts FROM pl),
  pj AS (SELECT {key}, c, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * {len(q)} AS spot FROM pi),
  pk AS (SELECT *, greatest(0, spot - 100) AS b, least(length(c), spot + {len(q)} + 100) AS e FROM pj),
  pm AS (SELECT *, position(' ' IN reverse(substr(c, b + 1, spot - b))) AS back FROM pk),
  pn AS (SELECT *, CASE WHEN b > 0 AND back > 0 AND spot - back > b THEN spot - back + 1 ELSE b END AS st FROM pm),
  px AS (SELECT {key}, list(CASE WHEN st > 0 THEN '...' ELSE '' END || {strip("substr(c, st + 1, e - st)")} || CASE WHEN e < length(c) THEN '...' ELSE '' END ORDER BY i) AS excerpts FROM pn GROUP BY {key})"""  # noqa: E731


@query("WITH" + _BM25 + f""", {_PLACES("text", "with the", "documents", "doc_id")}, x AS (SELECT conv_id AS session_id, round(score, 4) AS score, ['known'] AS excerpts FROM s WHERE hits > 0)
  SELECT coalesce(x.session_id, a.doc_id) AS session_id, coalesce(x.score, 1.0::DOUBLE) AS score, array_to_string(coalesce(a.excerpts, x.excerpts), '|') AS excerpts, a.excerpts IS NOT NULL AS has_archive_matches, CASE WHEN x.score IS NULL THEN 0 ELSE 1 END AS rank_group
  FROM x FULL JOIN px a ON x.session_id = a.doc_id""")
def search_archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = search.bm25(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"), TERMS)
    known = k.select(F.col("conv_id").alias("session_id"), F.round("score", 4).alias("score"), F.array(F.lit("known")).alias("excerpts"))
    archive = search.substring_matches(table(spark, sf_dir, "documents"), "doc_id", "text", "with the").select(F.col("doc_id").alias("session_id"), "excerpts")
    return search.merge_archive(known, archive).withColumn("excerpts", F.array_join("excerpts", "|"))


@query(f"WITH {_PLACES('text', 'of the', 'documents', 'doc_id')} SELECT d.doc_id, 1.0::DOUBLE AS score, array_to_string(excerpts, '|') AS excerpts FROM documents d JOIN px USING (doc_id) ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20")
def search_substring_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.substring_matches(table(spark, sf_dir, "documents"), "doc_id", "text", "of the", "n_chars", 20)
    return found.select("doc_id", "score", F.array_join("excerpts", "|").alias("excerpts"))


_EXCERPTS = f"""{TURNS},
  h AS (SELECT *, list_filter(['with', 'avec', 'der'], lambda x: contains(lower(content), x)) AS hit FROM t),
  p AS (SELECT *, list_min(list_transform(hit, lambda x, i: [position(x IN lower(content)), i, length(x)])) AS f, length(content) AS n FROM h WHERE len(hit) > 0),
  b AS (SELECT *, f[1] - 1 AS spot, greatest(0, f[1] - 1 - 200) AS b0, least(n, f[1] - 1 + f[3] + 200) AS e0 FROM p),
  b1 AS (SELECT *, b0 - length(regexp_extract(substr(content, 1, b0), '[\\p{{L}}\\p{{N}}]*$')) AS w FROM b),
  b2 AS (SELECT *, position(' ' IN substr(content, w + 1, spot - w)) AS sp, position(' ' IN reverse(substr(content, spot + 1, e0 - spot))) AS back FROM b1),
  c AS (SELECT *, CASE WHEN b0 > 0 THEN CASE WHEN sp > 0 THEN w + sp ELSE w END ELSE 0 END AS st, CASE WHEN e0 < n AND back > 0 THEN e0 - back ELSE e0 END AS en FROM b2),
  x AS (SELECT session_id, msg_idx, role, hit, CASE WHEN st > 0 THEN '...' ELSE '' END || {strip("substr(content, st + 1, en - st)")} || CASE WHEN en < n THEN '...' ELSE '' END AS excerpt FROM c),
  y AS (SELECT *, row_number() OVER (PARTITION BY session_id, lower(substr(excerpt, 1, 100)) ORDER BY msg_idx) AS again FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS rank FROM y WHERE again = 1)"""


@query(f"WITH {_EXCERPTS} SELECT session_id, msg_idx, role, excerpt, len(hit) AS n_terms, rank FROM z WHERE rank <= 3")
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.excerpts(turns(spark, sf_dir), TERMS)
    return found.select("session_id", "msg_idx", "role", "excerpt", F.size("matched_terms").cast("long").alias("n_terms"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_EXCERPTS}, s AS (SELECT *, CASE WHEN role = 'assistant' THEN 2.0::DOUBLE ELSE 0.0 END + len(hit) + least(length(excerpt) / 150.0::DOUBLE, 2.0) AS score FROM z WHERE rank <= 3) SELECT session_id, arg_max(msg_idx, (round(score, 6), -msg_idx)) AS msg_idx, round(max(score), 4) AS score FROM s GROUP BY session_id")
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_excerpt(search.excerpts(turns(spark, sf_dir), TERMS)).select("session_id", "msg_idx", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
  s AS (SELECT label AS session_id, vec_id AS chunk, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)
  SELECT session_id::BIGINT AS session_id, arg_max(chunk, (score, -chunk)) AS chunk, round(max(score), 6) AS score FROM s GROUP BY session_id ORDER BY max(score) DESC, session_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    first = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    top = search.vector_top(v.crossJoin(F.broadcast(first)), F.col("q"), "label", "vec_id", "embedding")  # one query row
    return top.select(F.col("session_id").cast("long").alias("session_id"), "chunk", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
  s AS (SELECT query_id, label AS session_id, vec_id AS chunk, round(list_cosine_similarity(embedding::DOUBLE[], q), 12) AS score FROM embeddings, q),
  b AS (SELECT query_id, session_id, arg_max(chunk, (score, -chunk)) AS chunk, max(score) AS score FROM s GROUP BY query_id, session_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS rank FROM b)
  SELECT query_id, session_id::BIGINT AS session_id, chunk, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = search.vector_top_all(v, queries, "label", "vec_id", "embedding")
    return top.select("query_id", F.col("session_id").cast("long").alias("session_id"), "chunk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _chunks_sql(size: int, overlap: int, most: int, snap: int = 200) -> str:
    step = size - overlap
    return f"""WITH d AS (SELECT doc_id, text, length(text) AS n, (length(text) - {overlap}) // {step} + 1 <= {most} AS few FROM documents WHERE length(text) > 0),
      k AS (SELECT *, CASE WHEN n <= {size} THEN 1 WHEN few THEN least({most}, ceil(n / {step}.0)::BIGINT) ELSE {most} END AS c FROM d),
      i AS (SELECT doc_id, text, n, few OR n <= {size} AS few, unnest(range(c)) AS j FROM k),
      s AS (SELECT *, CASE WHEN few THEN j * {step} WHEN j = {most - 1} THEN n - {size} ELSE floor((n - {size}) / {most - 1}.0::DOUBLE * j)::BIGINT END AS st FROM i),
      p AS (SELECT *, substr(text, st + 1, {size}) AS part FROM s), z AS (SELECT *, CASE WHEN length(part) > {snap} THEN right(part, {snap}) ELSE part END AS zone FROM p),
      b AS (SELECT *, position(chr(10) IN reverse(zone)) AS back FROM z),
      x AS (SELECT doc_id, j AS chunk_index, CASE WHEN few AND st + {size} < n AND back > 0 AND length(zone) - back > 0 THEN substr(part, 1, length(part) - back + 1) ELSE part END AS x FROM b)
      SELECT doc_id, chunk_index, length(x) AS chars, md5(x) AS digest FROM x"""


@query(_chunks_sql(P.CHUNK_CHARS, P.CHUNK_OVERLAP, P.CHUNK_MOST))
def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = search.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("digest"))


@query(_chunks_sql(400, 50, 8))
def vector_chunks_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = search.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 400, 50, 8)
    return c.select("doc_id", "chunk_index", F.length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("digest"))


@query(f"WITH {_EXCERPTS}, r AS (SELECT session_id, count(*) AS n_excerpts FROM z WHERE rank <= 5 GROUP BY session_id) SELECT session_id, 0.5::DOUBLE AS score, n_excerpts FROM r ORDER BY n_excerpts DESC, session_id LIMIT 10")
def search_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fulltext(turns(spark, sf_dir), TERMS).withColumn("score", F.col("score").cast("double"))


@query(f"WITH b25 AS (WITH{_BM25} SELECT conv_id AS session_id, round(score, 4) AS score FROM s WHERE hits > 0 ORDER BY round(s.score, 9) DESC, conv_id LIMIT 25), {_EXCERPTS} SELECT b25.session_id, score, coalesce(string_agg(excerpt, '|' ORDER BY rank) FILTER (WHERE rank <= 3), '') AS excerpts FROM b25 LEFT JOIN z ON b25.session_id = z.session_id GROUP BY b25.session_id, score")
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.keyword_top(table(spark, sf_dir, "conversations"), "conv_id", ["text"], " OR ".join(TERMS), 25).select(F.col("conv_id").alias("session_id"), F.round("score", 4).alias("score"))
    found = search.with_excerpts(top, turns(spark, sf_dir), TERMS)
    return found.withColumn("excerpts", F.array_join(F.transform("excerpts", lambda e: e["excerpt"]), "|"))


@query(f"""WITH k AS (SELECT p_partkey, string_split(p_name || ' files check ' || p_type, ' ') AS kw FROM part), f AS (SELECT p_partkey, list_filter(kw, lambda x: lower(x) NOT IN ({', '.join(repr(w) for w in P.SEARCH_STOPWORDS)}) AND length(x) > 2) AS kw FROM k)
  SELECT p_partkey, array_to_string(list_concat(list_filter(kw, lambda x: lower(x) IN ('box', 'steel')), list_filter(kw, lambda x: lower(x) NOT IN ('box', 'steel')))[1:5], ' ') AS topics FROM f""")
def result_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat("p_name", F.lit(" files check "), "p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.topics(words, F.array(F.lit("Box"), F.lit("steel"))), " ").alias("topics"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Task: ' || p_name || ' | Outcome: ' || p_type || ' is done' ELSE p_name || ' ' || p_type END AS summary, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS task FROM part),
  y AS (SELECT p_partkey, CASE WHEN contains(summary, ' | Outcome: ') THEN string_split(summary, ' | Outcome: ')[2] WHEN task <> '' AND length(task) < length(summary) THEN task ELSE summary END AS t FROM x)
  SELECT p_partkey, CASE WHEN length(t) <= 20 THEN t ELSE substr(t, 1, 17) || '...' END AS short FROM y""")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    summary = F.when(key % 3 == 0, F.concat(F.lit("Task: "), "p_name", F.lit(" | Outcome: "), "p_type", F.lit(" is done"))).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", C.short_summary(summary, F.when(key % 2 == 0, F.col("p_name")), 20).alias("short"))


@query("""WITH s AS (SELECT user_id AS session_id, min(ts) AS started_at, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(ts) END AS indexed_at FROM events GROUP BY user_id), a AS (SELECT user_id AS session_id, max(ts) + INTERVAL 1 HOUR AS updated_at FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
  SELECT s.session_id FROM s LEFT JOIN a USING (session_id) WHERE indexed_at IS NULL OR updated_at > indexed_at ORDER BY updated_at DESC NULLS LAST, started_at DESC, session_id LIMIT 10""")
def vectors_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    s = e.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"), F.when(F.col("user_id") % 3 != 0, F.max("ts")).alias("indexed_at"))
    a = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("session_id")).agg((F.max("ts") + F.expr("interval 1 hour")).alias("updated_at"))
    return vectors.stale(s, a).select("session_id")


@query("""WITH d AS (SELECT doc_id AS session_id, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT session_id, CASE WHEN n <= 4000 THEN 1 ELSE least(50, ceil(n / 3500.0)::BIGINT) END AS chunks FROM d WHERE session_id % 2 = 0)
  SELECT (SELECT count(*) FROM d) AS sessions, count(*) AS indexed, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS vectors, (SELECT count(*) FROM d) - count(*) AS pending FROM c""")
def vectors_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the documents indexed, some of them twice, some deleted and indexed again."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("session_id"), "text", F.lit("").alias("summary"))
    some = d.where("session_id % 2 = 0")
    made = vectors.index(some)
    made = vectors.replace(vectors.delete(made, some.where("session_id % 4 = 0")), vectors.index(some.where("session_id % 4 = 0 or session_id % 6 = 0")))
    return vectors.figures(d, made)


@query("SELECT doc_id AS session_id FROM documents WHERE length(text) > 0 AND doc_id % 2 = 1")
def vectors_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("session_id"), "text", F.lit("").alias("summary"))
    return vectors.not_indexed(d, vectors.index(d.where("session_id % 2 = 0"))).select("session_id")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label AS session_id, vec_id AS chunk, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE label % 2 = 1 AND vec_id % 3 = 0)
  SELECT session_id::BIGINT AS session_id, arg_max(chunk, (score, -chunk)) AS chunk, round(max(score), 6) AS score, 'chunk ' || arg_max(chunk, (score, -chunk)) AS preview FROM s GROUP BY session_id ORDER BY max(score) DESC, session_id LIMIT 10""")
def vectors_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.orderBy("vec_id").limit(1).first()["embedding"]])
    rows = v.select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("chunk_index"), "embedding", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
                    F.concat(F.lit("/p"), (F.col("label") % 2).cast("string")).alias("project_path"), F.when(F.col("vec_id") % 3 == 0, "message").otherwise("summary").alias("chunk_type"))
    return vectors.found(rows, q, project="/p1", chunk_types=["message"]).withColumn("score", F.round("score", 6))


_STOP = ", ".join(f"'{w}'" for w in P.FUZZY_STOPWORDS)
_VOCAB = rf"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:-+[\p{{L}}\p{{N}}_]+)*')) AS term FROM documents),
  v AS (SELECT term, count(DISTINCT doc_id) AS frequency FROM w WHERE regexp_full_match(term, '[a-z][a-z0-9_-]*') AND length(term) >= 4 AND term NOT IN ({_STOP}) GROUP BY term)"""


@query(f"WITH {_VOCAB} SELECT term, frequency FROM v")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.vocabulary(table(spark, sf_dir, "documents"), F.col("text"), "documents").select("term", "frequency")


@query(f"WITH {_VOCAB}" + r""", t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS term FROM part)),
  x AS (SELECT t.term, v.term AS word, v.frequency, damerau_levenshtein(t.term, v.term) AS edits FROM t, v
        WHERE length(t.term) >= 4 AND t.term NOT IN (SELECT term FROM v) AND abs(length(t.term) - length(v.term)) <= 2 AND t.term NOT IN (""" + _STOP + r""")),
  r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY edits, frequency DESC, word) AS r FROM x WHERE edits <= 2)
  SELECT term, word AS correction, edits FROM r WHERE r = 1""")
def fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    words = fuzzy.vocabulary(table(spark, sf_dir, "documents"), F.col("text"), "documents")
    return fuzzy.closest(terms, words).select("term", "correction", F.col("edits").cast("long").alias("edits"))


@query(rf"WITH {_VOCAB}, q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM conversations) SELECT term FROM q WHERE regexp_full_match(term, '[a-z0-9]{{3,}}') AND term NOT IN (SELECT term FROM v)")
def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fuzzy.vocabulary(table(spark, sf_dir, "documents"), F.col("text"), "documents")
    return search.unknown_terms(table(spark, sf_dir, "conversations"), "text", words)


@query(f"WITH {_VOCAB}" + r""", q AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\w+')) AS term, generate_subscripts(regexp_extract_all(lower(p_name), '\w+'), 1) AS i FROM part), t AS (SELECT DISTINCT term FROM q),
  x AS (SELECT t.term, v.term AS word, v.frequency, damerau_levenshtein(t.term, v.term) AS edits FROM t, v WHERE length(t.term) >= 4 AND t.term NOT IN (SELECT term FROM v) AND abs(length(t.term) - length(v.term)) <= 2 AND t.term NOT IN (""" + _STOP + r""") AND NOT regexp_full_match(t.term, '\d+')),
  r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY edits, frequency DESC, word) AS r FROM x WHERE edits <= 2), f AS (SELECT q.p_partkey, q.i, coalesce(r.word, q.term) AS w, r.word IS NOT NULL AS hit FROM q LEFT JOIN r ON r.term = q.term AND r.r = 1)
  SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS query, count(*) FILTER (WHERE hit) AS corrections FROM f GROUP BY p_partkey""")
def corrected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fuzzy.vocabulary(table(spark, sf_dir, "documents"), F.col("text"), "documents")
    return fuzzy.corrected_queries(table(spark, sf_dir, "part"), "p_partkey", "p_name", words)


@query(rf"""WITH {_VOCAB.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 0)")}, {_VOCAB.replace("w AS", "w2 AS").replace("v AS", "v2 AS").replace("FROM w WHERE", "FROM w2 WHERE").replace("doc_id, unnest", "doc_id, unnest").replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 1)")}
  SELECT coalesce(v.term, v2.term) AS term, coalesce(v.frequency, 0) + coalesce(v2.frequency, 0) AS frequency, concat_ws(',', CASE WHEN v.term IS NOT NULL THEN 'even' END, CASE WHEN v2.term IS NOT NULL THEN 'odd' END) AS sources FROM v FULL JOIN v2 ON v.term = v2.term""")
def vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    even, odd = (fuzzy.vocabulary(d.where(f"doc_id % 2 = {i}"), F.col("text"), name) for i, name in enumerate(("even", "odd")))
    return fuzzy.merge_vocabulary(even, odd).withColumn("sources", F.array_join("sources", ","))
