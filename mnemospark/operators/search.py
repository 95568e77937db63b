"""Keyword, vector and hybrid search with recency-decayed ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.functions import stemming


def parse(query: str) -> tuple[list[str], bool]:
    """The distinct terms of a query, and whether all must be there: they must unless the query joins terms with OR."""
    any_term = " OR " in query
    return sorted({w for w in re.findall("[a-z0-9]+", query.replace(" OR ", " ").lower())}), not any_term


def _equals(term: str):
    return lambda x: x == F.lit(term)


#: So many different words of a query's stems go into an expression; beyond that, words are stemmed where they stand.
MOST_FORMS = 10_000


def _by_stem(docs: DataFrame, text: Column, terms: list[str], most: int = MOST_FORMS):
    """For each stem, what tells whether a word has it.

    Distinct words that begin as every word of a stem does are stemmed once; the few that have a wanted stem become a list. The
    count in the condition keeps it above the aggregation, which would else stem every word of every text.
    """
    beginnings = sorted({stemming.kept_beginning(t) for t in terms})
    words = docs.select(F.explode(F.array_distinct(F.filter(C.tokens(text), lambda x: C.starts_with_any(x, beginnings)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = [r["word"] for r in words.where((F.col("n") == 0) | stemming.stem_column(F.col("word")).isin(terms)).select("word").limit(most + 1).collect()]
    if len(found) > most:
        return lambda term: lambda x: F.startswith(x, F.lit(stemming.kept_beginning(term))) & (stemming.stem_column(x) == F.lit(term))
    forms = {t: sorted(w for w in found if stemming.stem(w) == t) for t in terms}
    return lambda term: lambda x: x.isin(forms[term])


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str], all_terms: bool = False, stems: bool = False) -> DataFrame:
    """(key, score) of the documents that hold a term, or all of them. Rows of one key are one document.

    Every row counts the query's terms and its own length, and rows of a key are added up with map-side sums, so that no
    document is ever put together. The corpus statistics are one row. With ``stems``, the terms are English stems, and
    stopwords of the documents do not count.
    """
    wanted, analyse = sorted(set(t.lower() for t in terms)), C.content_tokens if stems else C.tokens
    same = _by_stem(docs, text, wanted) if stems else _equals
    counted = docs.select(key, analyse(text).alias("tokens")).select(
        key, F.size("tokens").alias("dl"), *[F.size(F.filter("tokens", same(t))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    )
    counted = counted.groupBy(key).agg(F.sum("dl").alias("dl"), *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(wanted))])
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    scored = counted.crossJoin(F.broadcast(totals))  # totals is one row
    score, hits = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(P.LEAST_IDF), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (P.BM25_K1 + 1) / (tf + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * F.col("dl") / F.col("avgdl")))
        hits = hits + (tf > 0).cast("int")
    return scored.where(hits == len(wanted) if all_terms else hits > 0).select(key, score.alias("score"))


def keyword_top(docs: DataFrame, key: str, columns: list[str], query: str, limit: int = 10, stems: bool = False) -> DataFrame:
    """(key, score): the best rows for a query over some columns, texts or lists of them, best first; equal scores by key.

    Scores are compared to nine digits, as sums depend on their order.

    All terms must be there, or any of those joined by OR. With ``stems``, terms are English stems and stopwords do not count.
    """
    terms, every = parse(query)
    parts = [F.array_join(c, " ") if dict(docs.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    if stems:
        terms = sorted({stemming.stem(t) for t in terms if t not in P.SEARCH_STOPWORDS})
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    return bm25(docs, key, F.concat_ws(" ", *parts), terms, every, stems).orderBy(F.desc(F.round("score", 9)), key).limit(limit)


#: Fixed values of the public full-text rank: the weight of a word without a label, the sum of 1/k**2, the reach of a pair.
WORD_WEIGHT, INVERSE_SQUARES, RANK_REACH = 0.1, 1.64493406685, 100


def ranked(docs: DataFrame, keys: list[str], columns: list[str], query: str, limit: int | None = None, most: int = MOST_FORMS) -> DataFrame:
    """(keys, rank): rows that hold the English stems of all words of a query in some columns, by how near the words stand.

    Stop words neither ask nor match, but have positions; a query of stop words alone finds nothing. Two different words at
    distance d weigh 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))), and a row ranks at 1 minus the product of what the
    weights leave; pairs more than 100 words apart weigh less than 1e-16 and are left out, so that a row whose words never
    come nearer ranks at 0. A single word ranks at 0.1 / 1.64493 times the sum of 1 / k**2 over its occurrences. Null columns are
    empty; a repeated row is a row of its own. Equal ranks (nine digits) go by keys.

    The words of the wanted stems come from one aggregation over distinct words. The rest happens inside a row, so that nothing
    is shuffled but the best ``limit`` rows a task; a hit meets at most the 100 hits before it.
    """
    terms = sorted({stemming.stem(t) for t in parse(query)[0] if t not in stemming.ENGLISH_STOPWORDS})
    if not terms:
        return docs.select(*keys, F.lit(0.0).alias("rank")).limit(0)
    text = F.concat_ws(" ", *columns)
    same = _by_stem(docs, text, terms, most)
    asked = lambda x: ~x.isin(stemming.ENGLISH_STOPWORDS) & reduce(lambda a, b: a | b, [same(t)(x) for t in terms])
    which = lambda x: F.coalesce(*[F.when(same(t)(x), i) for i, t in enumerate(terms)])
    placed = F.filter(F.transform(C.tokens(text), lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: asked(x["word"]))
    rows = docs.select(*keys, F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), which(x["word"]).alias("term"))).alias("hits"))
    rows = rows.where(F.size(F.array_distinct(F.transform("hits", lambda x: x["term"]))) == len(terms))
    if len(terms) == 1:
        rank = F.aggregate(F.sequence(F.lit(1), F.size("hits")), F.lit(0.0), lambda s, k: s + WORD_WEIGHT / (k.cast("double") * k)) / INVERSE_SQUARES
    else:
        left = lambda h, o: 1 - WORD_WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp((h["pos"] - o["pos"]) / 1.5 - 2)))
        near = lambda h, o: (o["term"] != h["term"]) & (h["pos"] - o["pos"] <= RANK_REACH)
        before = lambda i: F.slice("hits", F.greatest(i - RANK_REACH, F.lit(0)) + 1, F.least(i, F.lit(RANK_REACH)))
        rank = 1 - F.aggregate(F.transform("hits", lambda h, i: F.aggregate(before(i), F.lit(1.0), lambda p, o: F.when(near(h, o), p * left(h, o)).otherwise(p))), F.lit(1.0), lambda p, q: p * q)
    out = rows.select(*keys, rank.alias("rank"))
    return out if limit is None else out.orderBy(F.desc(F.round("rank", 9)), *keys).limit(limit)


def with_decay(results: DataFrame, score: str, ts: str, as_of: Column, half_life: float = P.HALF_LIFE_DAYS) -> DataFrame:
    factor = C.decay(F.col(ts), as_of, half_life)
    return results.withColumn("decay_factor", F.round(factor, 3)).withColumn("decayed_score", F.round(F.coalesce(F.col(score), F.lit(0.5)) * factor, 4))


def recent(results: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; rows without a time stay."""
    return results.where(F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))))


def merge_hybrid(vector: DataFrame, keyword: DataFrame, key: str = "session_id", limit: int | None = None) -> DataFrame:
    """Vector results, and the keyword results of sessions that these do not hold, each with its source; the best ``limit``."""
    rest = keyword.join(vector.select(key), key, "left_anti")
    out = vector.withColumn("search_source", F.lit("vector")).unionByName(rest.withColumn("search_source", F.lit("keyword")))
    return out if limit is None else out.orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def merge_archive(existing: DataFrame, archive: DataFrame, key: str = "session_id", limit: int | None = None) -> DataFrame:
    """Excerpts of archive matches (lists) replace those of known results; other archive matches come first."""
    a = archive.select(key, F.col("excerpts").alias("archive_excerpts"), F.lit(1.0).alias("archive_score"))
    out = existing.join(a, key, "full_outer").select(
        key, F.coalesce("score", "archive_score").alias("score"), F.coalesce("archive_excerpts", "excerpts").alias("excerpts"),
        F.col("archive_excerpts").isNotNull().alias("has_archive_matches"), F.when(F.col("score").isNull(), 0).otherwise(1).alias("rank_group"),
    )
    return out if limit is None else out.orderBy("rank_group", F.desc("score"), key).limit(limit)


def substring_matches(docs: DataFrame, key: str, text: str, query: str, newest: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents that hold the query as it stands, whatever the case, with score 1 and up to three excerpts; newest first.

    % and _ mean themselves.
    """
    out = docs.where(F.contains(F.lower(text), F.lit(query.lower())))
    if limit is not None:  # before the excerpts, so that only what is shown is cut
        out = out.orderBy(*([F.desc_nulls_last(newest)] if newest else []), key).limit(limit)
    return out.withColumn("score", F.lit(1.0)).withColumn("excerpts", C.excerpts_of(F.col(text), query))


def excerpts(messages: DataFrame, terms: list[str], per_session: int = 3) -> DataFrame:
    """The first messages of each session that hold a term, with the text around it; equal beginnings once, whatever the case."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    hit = F.filter(wanted, lambda t: F.contains(F.lower("content"), t))
    found = messages.withColumn("matched_terms", hit).where(F.size("matched_terms") > 0).withColumn("excerpt", C.excerpt_around(F.col("content"), F.col("matched_terms")))
    once = Window.partitionBy("session_id", F.lower(F.substring("excerpt", 1, 100))).orderBy("msg_idx")
    found = found.withColumn("again", F.row_number().over(once)).where("again = 1")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= per_session).select("session_id", "msg_idx", "role", "excerpt", "matched_terms", "rank")


def with_excerpts(results: DataFrame, messages: DataFrame, terms: list[str], per_session: int = 3) -> DataFrame:
    """Results with the list of their sessions' excerpts; empty if there is none."""
    found = excerpts(messages.join(results.select("session_id").distinct(), "session_id", "left_semi"), terms, per_session)
    listed = found.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "excerpt", "matched_terms"))).alias("excerpts"))
    return results.join(listed, "session_id", "left").withColumn("excerpts", F.coalesce("excerpts", F.array().cast(listed.schema["excerpts"].dataType)))


def fulltext(messages: DataFrame, terms: list[str], limit: int = 10, per_session: int = 5) -> DataFrame:
    """The last resort: sessions with most excerpts that hold a term: session_id, score, n_excerpts."""
    found = excerpts(messages, terms, per_session).groupBy("session_id").agg(F.count("*").alias("n_excerpts"))
    return found.orderBy(F.desc("n_excerpts"), "session_id").limit(limit).select("session_id", F.lit(0.5).alias("score"), "n_excerpts")


def best_excerpt(found: DataFrame) -> DataFrame:
    """The best excerpt of each session: assistant +2, matched terms, length up to 2; the first at a tie."""
    score = F.when(F.col("role") == "assistant", 2.0).otherwise(0.0) + F.size("matched_terms") + F.least(F.length("excerpt") / 150.0, F.lit(2.0))
    best = F.max_by(F.struct("msg_idx", "excerpt", score.alias("score")), F.struct(F.round(score, 6), -F.col("msg_idx")))
    return found.groupBy("session_id").agg(best.alias("best")).select("session_id", "best.*")


def vector_top(vectors: DataFrame, query: Column, session: str, chunk: str, vector: str, limit: int = 10, recency_cap: int | None = None, scope: Column | None = None) -> DataFrame:
    """The best chunk of each session by cosine to a query vector, best sessions first. ``scope``: a condition on the rows, as of a project."""
    if scope is not None:
        vectors = vectors.where(scope)
    if recency_cap is not None:
        vectors = vectors.orderBy(F.desc(chunk)).limit(recency_cap)
    scored = vectors.select(F.col(session).alias("session_id"), F.col(chunk).alias("chunk"), C.cosine(F.col(vector), query).alias("score"))
    best = scored.groupBy("session_id").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("best")).select("session_id", "best.*")
    return best.orderBy(F.desc("score"), "session_id").limit(limit)


def vector_top_all(vectors: DataFrame, queries: DataFrame, session: str, chunk: str, vector: str, limit: int = 10, block: int = 2048) -> DataFrame:
    """(query_id, session_id, chunk, score, rank): for every query, the best chunk of each session, best sessions first.

    ``queries`` has query_id and query. They are broadcast in blocks of ``block`` rows; each partition scores its vectors by a
    matrix product and hands on the best ``limit`` sessions a query. Scores are compared to 12 digits, as sums of products
    depend on their order. Vectors without direction match nothing.
    """
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, session_id {vectors.schema[session].dataType.simpleString()}, chunk {vectors.schema[chunk].dataType.simpleString()}, score double"
    given = vectors.where(F.col(vector).isNotNull()).select(F.col(session).alias("session_id"), F.col(chunk).alias("chunk"), F.col(vector).alias("vector"))

    def unit(rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([np.asarray(r, np.float64) for r in rows])
        length = np.sqrt((x * x).sum(1))
        kept = length > 0
        return x[kept] / length[kept, None], kept

    def by(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query_id", "score", "chunk"], ascending=[True, False, True]).drop_duplicates(["query_id", "session_id"])
        return frame.sort_values(["query_id", "score", "session_id"], ascending=[True, False, True]).groupby("query_id").head(limit)

    def scored(ids: list, rows: list) -> DataFrame:
        directions, kept = unit(rows)
        shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids)[kept], directions))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            best = None
            for batch in batches:
                for at in range(0, len(batch) if len(names) else 0, 512):
                    part = batch.iloc[at : at + 512]
                    x, some = unit(part["vector"])
                    part = part[some]
                    if len(part):
                        cosines = np.round(x @ q.T, 12)
                        found = []
                        for _, own in part.reset_index(drop=True).sort_values("chunk").groupby("session_id", dropna=False):
                            top = cosines[own.index].argmax(0)  # the least chunk at a tie
                            found.append(pd.DataFrame({"query_id": names, "session_id": own["session_id"].iloc[0], "chunk": own["chunk"].to_numpy()[top], "score": cosines[own.index[top], np.arange(len(names))]}))
                        best = by(pd.concat(found if best is None else [best, *found]))
            if best is not None:
                yield best

        return given.mapInPandas(run, kind)

    out, ids, rows = None, [], []
    for r in queries.where("query is not null").toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["query"])
        if len(ids) == block:
            full = scored(ids, rows)
            out, ids, rows = full if out is None else out.union(full), [], []
    if ids or out is None:
        last = scored(ids, rows) if ids else vectors.sparkSession.createDataFrame([], kind)
        out = last if out is None else out.union(last)
    best = out.groupBy("query_id", "session_id").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("best")).select("query_id", "session_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "session_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def chunks(docs: DataFrame, key: str, text: str, size: int = P.CHUNK_CHARS, overlap: int = P.CHUNK_OVERLAP, most: int = P.CHUNK_MOST, snap: int = 200) -> DataFrame:
    """Overlapping chunks of a text: key, chunk_index, chunk_text; an empty text has none.

    A chunk that is not the last ends behind the last line end of its final ``snap`` characters, if there is one behind
    their first. Of a text with more than ``most`` chunks, the first, the last, and others evenly spaced by characters
    between them are taken whole.
    """
    step, n = size - overlap, F.length(text)
    few = F.floor((n - overlap) / step) + 1 <= most
    count = F.when(n <= size, 1).when(few, F.least(F.lit(most), F.ceil(n / step).cast("int"))).otherwise(most)
    cut = docs.where(n > 0).select(key, text, F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_index", "i"), (few | (n <= size)).alias("few"))
    spaced = F.when(F.col("i") == most - 1, n - size).otherwise(F.floor((n - size) / float(most - 1) * F.col("i")))
    start = F.when(F.col("few"), F.col("i") * step).otherwise(spaced).cast("int")
    part = F.substring(F.col(text), start + 1, F.lit(size))
    zone = F.when(F.length(part) > snap, F.substring(part, -snap, snap)).otherwise(part)
    back = F.position(F.lit("\n"), F.reverse(zone))
    line = F.col("few") & (start + size < n) & (back > 0) & (F.length(zone) - back > 0)
    return cut.select(key, F.col("chunk_index").cast("long"), F.when(line, F.substring(part, F.lit(1), F.length(part) - back + 1)).otherwise(part).alias("chunk_text"))


def unknown_terms(queries: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Distinct query terms of at least three characters that the vocabulary lacks."""
    asked = queries.select(F.explode(C.query_terms(F.col(text), 1 << 30)).alias("term")).distinct()
    return asked.join(vocabulary.select("term"), "term", "left_anti")
