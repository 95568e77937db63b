"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks of bytes. The distinct blocks are sorted into integer names; then adjacent pairs of
names are named in the same way, again and again, until every document has one name. Documents are equal exactly if they
end with the same name at the same level, as equal names stand for equal bytes at every level.

Block contents cross the network once, after map-side elimination of repeats, so that a hot group of copies shrinks to
one row a map task before the shuffle. The way back from block to name goes over a 64-bit hash; where distinct blocks
share a hash, which the named table shows, their documents go by the contents themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import join_to_groups, materialise, release, unused

BLOCK_BYTES = 4096


def _blocks(size: int):
    """The fixed-size blocks of the binary column ``bytes``; an empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("bytes", i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, keys: list[str], to: str) -> DataFrame:
    """Integer names for distinct rows: their place in the sorted order of each hash partition, behind its number."""
    return distinct.sortWithinPartitions(*keys).withColumn(to, F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Null text counts as empty. Of equal texts the row with the largest id stays (a null id is smaller than any other; of
    repeated rows with that id, one stays). An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    cut = given.select("doc_id", F.sha2("bytes", 256).alias("text_sha256"), _blocks(block_bytes).alias("blocks"))
    rows = materialise(
        cut.select("doc_id", "text_sha256", F.transform("blocks", lambda b: F.xxhash64(b)).alias("hashes")).withColumn("rid", F.monotonically_increasing_id()),
        "rows",
    )
    parts = given.select(F.explode(_blocks(block_bytes)).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    counted = parts.groupBy("h", "block").agg(F.count("*").alias("rows"))
    names = materialise(_named(counted, ["h", "block"], "name").select("h", "name", "rows"), "names")

    shared = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    placed = rows.select("rid", F.posexplode("hashes").alias("i", "h"))
    if shared.isEmpty():
        level = join_to_groups(placed, names, ["h"], "rows", names.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]).select("rid", "i", "name")
    else:  # distinct blocks under one hash: go by their contents
        full = _named(parts.join(shared, "h", "left_semi").distinct(), ["h", "block"], "name").select("h", "block", (-1 - F.col("name")).alias("name"))
        full = materialise(full, "names")
        odd = given.select("doc_id", F.sha2("bytes", 256).alias("text_sha256"), F.posexplode(_blocks(block_bytes)).alias("i", "block")).withColumn("h", F.xxhash64("block"))
        odd = odd.join(full, ["h", "block"]).select("doc_id", "text_sha256", "i", "name").distinct()
        odd = rows.alias("r").join(odd.alias("o"), F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.text_sha256") == F.col("o.text_sha256"))).select("rid", "i", "name")
        plain = placed.join(shared, "h", "left_anti").join(names.select("h", "name"), "h").select("rid", "i", "name")
        level = plain.union(odd)

    most = rows.agg(F.max(F.size("hashes"))).first()[0] or 1
    sizes = rows.select("rid", F.size("hashes").alias("n_blocks"))
    done = level.join(sizes.where("n_blocks = 1"), "rid").select("rid", F.lit(0).alias("level"), "name")
    level = level.join(sizes.where("n_blocks > 1").select("rid"), "rid", "left_semi")
    depth = 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        pairs = materialise(
            level.groupBy("rid", F.expr("i div 2").cast("int").alias("i")).agg(F.max(F.expr("if(i % 2 = 0, name, null)")).alias("x"), F.max(F.expr("if(i % 2 = 1, name, null)")).alias("y"))
            .select("rid", "i", "x", F.coalesce("y", F.lit(-(1 << 62))).alias("y")),
            "pairs",
        )
        pair_names = materialise(_named(pairs.select("x", "y").distinct(), ["x", "y"], "name"), "names")
        level = pairs.join(pair_names, ["x", "y"]).select("rid", "i", "name")
        last = level.join(sizes.where(f"n_blocks > {1 << depth - 1} and n_blocks <= {1 << depth}"), "rid").select("rid", F.lit(depth).alias("level"), "name")
        done = done.union(last)
        level = level.join(sizes.where(f"n_blocks > {1 << depth}").select("rid"), "rid", "left_semi")

    release(rows.sparkSession)
    named = materialise(rows.select("rid", "doc_id", "text_sha256", F.size("hashes").alias("n_blocks")).join(done, "rid"), "identities")
    groups = materialise(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return join_to_groups(named, groups, ["level", "name"], "group_size", named.count()).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256", "n_blocks"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns, of whatever names and types.

    Null texts are empty ones, a null id is smaller than any other. Of rows that repeat id and text, that with the first
    JSON form stays. An empty table gives no rows.
    """
    key, text, found_key, found_text, rows = unused(docs, "key", "text_sha", "found_key", "found_sha", "rows")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(found_key), F.col("text_sha256").alias(found_text))
    hashed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(text, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = F.col(key).eqNullSafe(F.col(found_key)) & (F.col(text) == F.col(found_text))
    found = hashed.join(kept, same, "left_semi")
    repeated = hashed.groupBy(key, text).agg(F.count("*").alias(rows)).where(F.col(rows) > 1).select(F.col(key).alias(found_key), F.col(text).alias(found_text))
    once = found.join(repeated, same, "left_anti").select(docs.columns)
    whole = F.struct(*docs.columns)
    again = found.join(repeated, same, "left_semi").groupBy(key, text).agg(F.min_by(whole, F.to_json(whole)).alias(rows)).select(f"{rows}.*")
    return once.union(again)
