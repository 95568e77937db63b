"""Registered queries of the training-data operators: thin applications to the given tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import language_id, toxicity
from mnemospark.llm.common import fold
from mnemospark.llm.embedding_dedup import link_vectors
from mnemospark.llm.exact_dedup import exact_dedup
from mnemospark.llm.lm_scoring import score_held_out
from mnemospark.llm.mixing import mix
from mnemospark.llm.near_dedup import near_dedup
from mnemospark.llm.packing import pack
from mnemospark.llm.phrases import collocations
from mnemospark.llm.quality import quality_rules
from mnemospark.llm.substring_dedup import repeated_spans
from mnemospark.llm.trie import conversation_trie
from mnemospark.llm.warc import export, read_archives, read_files, write_archives
from mnemospark.operators.staging import shared_dir, shuffles_removed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter are und with score 0; repeated rows each get a row; an empty table gives none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(fold("doc_id", 3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the score of a text without words; repeated rows each get a row; an empty table gives none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, weights).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; of repeated rows with the largest id one stays; an empty table gives no rows."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows that repeat id and text are one document with a row each; an empty table gives no rows."""
    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0, a null source is one of its own, the last; repeated rows each take part; an empty table gives no rows."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without words link with nothing; repeated rows each get a row; an empty table gives none."""
    return near_dedup(_table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or hold null or non-finite components link with nothing; repeated rows each get a row; an empty table gives none."""
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, their only token is the end; repeated rows each get a row; an empty table gives none."""
    scored = score_held_out(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; repeated rows are records of their own; an empty table gives no rows."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        written = export(write_archives(_table(spark, sf_dir, "pages")), folder).agg(F.count("*")).first()[0]
    found = read_files(spark, folder) if written else read_archives(spark.createDataFrame([], "content binary"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, their only id is 0; repeated rows are documents of their own; an empty table gives no rows."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, a null language is und; repeated rows count again; an empty table gives no rows."""
    return collocations(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal or null turns stand by role and text; rows without a conv_id belong to no conversation; an empty table gives no rows."""
    conv = F.col("conv_id")
    return conversation_trie(_table(spark, sf_dir, "conversations"), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and fail; repeated rows each get a row; an empty table gives none."""
    found = quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_toxicity, op3_exact_dedup, op4_substring_dedup, op5_source_mixing, op6_minhash_dedup,
    op7_embedding_dedup, op8_lm_scoring, op9_warc, op10_packing, op11_phrases, op12_prefix_trie, op13_quality_rules,
)}

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 4096.0)) AS INTEGER) AS n_blocks
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""",
    "op5_source_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
        w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS lim,
                     1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM n),
        c AS (SELECT *, budget - coalesce(CAST(sum(lim) OVER o AS DOUBLE), 0) AS left_, sum(w) OVER (ORDER BY lim / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw
              FROM w WINDOW o AS (ORDER BY lim / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, lim * rw <= left_ * w AS full_ FROM c),
        h AS (SELECT *, CASE WHEN full_ THEN CAST(lim AS DOUBLE)
                     ELSE (SELECT min(left_) FROM f x WHERE NOT x.full_) END AS lv FROM f),
        first_open AS (SELECT arg_min(left_, i2) AS left_, arg_min(rw, i2) AS rw FROM (SELECT left_, rw, row_number() OVER (ORDER BY lim / w, i) AS i2 FROM f WHERE NOT full_)),
        t AS (SELECT f.source, f.source_size, CASE WHEN full_ THEN CAST(lim AS DOUBLE) ELSE (o.left_ * w) / CAST(o.rw AS DOUBLE) END AS target FROM f, first_open o),
        p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(floor(floor(target) / greatest(source_size, 1)) * size
                 + greatest(0, least(size, floor(target) - floor(floor(target) / greatest(source_size, 1)) * greatest(source_size, 1) - ahead)) AS BIGINT) AS taken
        FROM p""",
    "op11_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)) GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
        inside AS (SELECT lang, f, array_to_string(v[i : j], ' ') AS phrase FROM (SELECT lang, f, string_split(phrase, ' ') AS v, unnest(range(1, m + 1)) AS i, m FROM g WHERE m > 2), (SELECT unnest(range(2, 6)) AS j) WHERE j <= m AND j > i AND j - i + 1 < m),
        k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.a)),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first_, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM k)),
        s AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * u.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
              FROM cuts u JOIN g x ON x.lang = u.lang AND x.phrase = u.first_ JOIN g y ON y.lang = u.lang AND y.phrase = u.rest JOIN t ON t.lang = u.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM b WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000""",
    "op12_prefix_trie": r"""
        WITH tab AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
        ids AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT c, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, x: xor(crc >> 8, tab[(xor(crc, x) & 255) + 1])), 4294967295) % 4 AS h FROM ids, tab),
        b AS (SELECT h.c, list_concat(coalesce(x.w[1 : h.h], []), h.w[h.h + 1 :]) AS s FROM h LEFT JOIN ids x ON x.c = h.c - h.c % 20),
        p AS (SELECT c, d, s[1 : d] AS k, len(s) AS n, s[d]['t'] AS last_ FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
        v AS (SELECT d, k, min(c) AS c, count(*) AS m, max(n) AS reach, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends, any_value(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(last_, '[^\x20\x09-\x0D]+')) END) AS words FROM p GROUP BY d, k),
        e AS (SELECT v.*, unnest(range(0, d + 1)) AS up FROM v),
        sums AS (SELECT up AS d, k[1 : up] AS k, sum((m - 1) * words) AS saved, count(*) FILTER (WHERE reach = d) AS leaves, count(*) FILTER (WHERE d = up + 1) AS kids FROM e GROUP BY 1, 2)
        SELECT v.c AS conv_id, v.d AS depth, q.c AS parent_conv_id, v.m AS n_convs, s.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM v JOIN sums s ON s.d = v.d AND s.k = v.k LEFT JOIN v q ON q.d = v.d - 1 AND q.k = v.k[1 : v.d - 1]""",
    "op13_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        p AS (SELECT r, i, length(w[i]) AS chars, len(w) AS n, array_to_string(w[i : i + 2], ' ') AS g3, array_to_string(w[i : i + 9], ' ') AS g10, md5(array_to_string(w[i : i + 100], ' ')) AS g101 FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        q AS (SELECT r, i, chars, i + 2 <= n AND count(*) FILTER (WHERE i + 2 <= n) OVER (PARTITION BY r, g3) > 1 AS d3, i + 9 <= n AND count(*) FILTER (WHERE i + 9 <= n) OVER (PARTITION BY r, g10) > 1 AS d10,
                     i + 100 <= n AND count(*) FILTER (WHERE i + 100 <= n) OVER (PARTITION BY r, g101) > 1 AS d101 FROM p),
        c AS (SELECT r, chars, d101, bool_or(d3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, bool_or(d10) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM q),
        s AS (SELECT r, sum(chars) AS chars, count(*) FILTER (WHERE c3) AS rep, coalesce(sum(chars) FILTER (WHERE c10), 0) AS covered, bool_or(d101) AS long_ FROM c GROUP BY r),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                     coalesce(rep, 0) AS n_repeat_words, CAST(coalesce(covered, 0) AS BIGINT) AS covered_chars, coalesce(long_, false) AS long_ FROM d LEFT JOIN l USING (r) LEFT JOIN s USING (r)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered_chars <= 30 * word_chars AND NOT long_ AS kept, covered_chars FROM f""",
}
