"""Rows drawn from message texts by patterns: errors, decisions, artifacts, concepts, facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _found(messages: DataFrame, patterns: list[tuple[Column, Column]]) -> DataFrame:
    """All matches of (array of matches, struct of what goes with them): the message's columns, pattern, match, found."""
    arrays = F.array(*[F.struct(F.lit(i).alias("pattern"), found.alias("matches"), extra.alias("extra")) for i, (found, extra) in enumerate(patterns)])
    out = messages.select("session_id", "msg_idx", "content", F.explode(arrays).alias("p"))
    return out.select("session_id", "msg_idx", "content", "p.pattern", "p.extra", F.posexplode("p.matches").alias("match", "found"))


def errors(messages: DataFrame) -> DataFrame:
    """Errors that users report, each signature once a session: session_id, msg_idx, kind, message, error_type, normalised, signature, confidence."""
    patterns = [(F.regexp_extract_all("content", F.lit(f"(?dms){p}"), F.lit(1)), F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))) for p, kind, c in P.ERROR_PATTERNS]
    out = _found(messages.where("role = 'user'"), patterns).withColumn("message", C.strip(F.col("found"))).where(F.length("message") >= 10)
    kind = C.error_type(F.col("message"))
    out = out.select("session_id", "msg_idx", "pattern", "match", "extra.*", "message", kind.alias("error_type"), C.normalise_error(F.col("message")).alias("normalised"))
    out = out.withColumn("signature", C.error_signature(F.col("error_type"), F.col("normalised")))
    return first_of(out, ["session_id", "signature"], ["msg_idx", "pattern", "match"]).drop("pattern", "match")


def solution(content: Column) -> Column:
    """What an answer says the solution is; null if it does not."""
    return F.coalesce(*[F.nullif(F.substring(C.strip(F.regexp_extract(content, f"(?i){p}", 1)), 1, 200), F.lit("")) for p in P.SOLUTION_PATTERNS])


def with_solutions(found: DataFrame, messages: DataFrame, ahead: int = P.ERROR_LOOK_AHEAD) -> DataFrame:
    """Errors with the first solution among the assistant's messages of the next few of their session.

    An answer is offered to the ``ahead`` places before it, which makes the band an equi-join.
    """
    answers = messages.where("role = 'assistant'").withColumn("solution", solution(F.col("content"))).where("solution is not null")
    offered = answers.select("session_id", F.col("msg_idx").alias("at"), "solution", F.explode(F.sequence(F.col("msg_idx") - ahead, F.col("msg_idx") - 1)).alias("msg_idx"))
    first = offered.groupBy("session_id", "msg_idx").agg(F.min_by("solution", "at").alias("solution"))
    return found.join(first, ["session_id", "msg_idx"], "left")


def error_patterns(found: DataFrame) -> DataFrame:
    """One row a signature: occurrences, sessions, first message and solution."""
    order = F.struct("session_id", "msg_idx")
    return found.groupBy("signature").agg(
        F.count("*").alias("occurrence_count"), F.min_by("error_type", order).alias("error_type"), F.min_by("normalised", order).alias("normalised_message"),
        F.max_by("solution", F.when(F.col("solution").isNotNull(), order)).alias("solution_summary"), F.array_sort(F.collect_set("session_id")).alias("source_sessions"),
    )


def decisions(messages: DataFrame) -> DataFrame:
    """Decisions in assistants' messages, each once a session: session_id, msg_idx, decision, category, hash, confidence, source."""
    patterns = [(F.regexp_extract_all("content", F.lit(f"(?dim){p}"), F.lit(1)), F.struct(F.lit(c).alias("confidence"), F.lit(s).alias("source"))) for p, c, s in P.DECISION_PATTERNS]
    out = _found(messages.where("role = 'assistant'"), patterns).withColumn("decision", C.strip(F.col("found"))).where(F.length("decision") >= 15)
    out = out.select("session_id", "msg_idx", "pattern", "match", "decision", C.decision_category(F.col("decision")).alias("category"), C.decision_hash(F.col("decision")).alias("hash"), "extra.*")
    return first_of(out, ["session_id", "hash"], ["msg_idx", "pattern", "match"]).drop("pattern", "match")


def insights(messages: DataFrame) -> DataFrame:
    """One row: how many errors, how many of them solved, and how many decisions messages hold."""
    found = with_solutions(errors(messages), messages).agg(F.count("*").alias("errors"), F.count("solution").alias("solved"))
    return found.crossJoin(decisions(messages).agg(F.count("*").alias("decisions")))  # one row each


def artifacts(messages: DataFrame) -> DataFrame:
    """Code blocks, lists, tables, configurations, errors and links: session_id, msg_idx, artifact_type, content, language, hash, line_count, char_count.

    Equal artifacts of a session count once.
    """
    all_of = lambda p, g=0: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    code = F.transform(F.arrays_zip(all_of(P.CODE_FENCE, 1).alias("hint"), all_of(P.CODE_FENCE, 2).alias("body")), lambda z: F.struct(F.lit("code_block").alias("type"), F.trim(z["body"], F.lit(" \n\t")).alias("body"), z["hint"].alias("hint")))
    plain = lambda kind, found, keep: F.transform(F.filter(found, keep), lambda b: F.struct(F.lit(kind).alias("type"), F.trim(b, F.lit(" \n\t")).alias("body"), F.lit("").alias("hint")))
    lines = lambda b: C.line_count(F.trim(b, F.lit(" \n\t")))
    urls = F.array_sort(F.array_distinct(F.filter(all_of(P.URL), lambda u: (F.length(u) > 20) & ~F.contains(u, F.lit("example.com")))))
    bundle = F.when(F.size(urls) >= 2, F.array(F.struct(F.lit("url").alias("type"), F.array_join(urls, "\n").alias("body"), F.lit("").alias("hint")))).otherwise(F.array().cast("array<struct<type:string,body:string,hint:string>>"))
    config = lambda b: F.size(F.coalesce(F.json_object_keys(b), F.array().cast("array<string>"))) >= 2
    found = F.concat(
        F.filter(code, lambda c: F.length(c["body"]) >= 20), plain("code_block", all_of(P.INDENTED_CODE), lambda b: (lines(b) >= 3) & (F.length(b) >= 50)),
        plain("list", all_of(P.NUMBERED_LIST), lambda b: lines(b) >= 3), plain("list", all_of(P.BULLET_LIST), lambda b: lines(b) >= 3),
        plain("table", all_of(P.TABLE), lambda b: (lines(b) >= 3) & F.contains(b, F.lit("---"))), plain("config", all_of(P.JSON_BLOCK), config),
        *[plain("error", all_of(p), lambda b: F.length(b) >= 50) for p in P.ERROR_TEXT], bundle,
    )
    out = messages.where("role in ('user', 'assistant')").select("session_id", "msg_idx", "role", F.posexplode(found).alias("place", "a"))
    body = F.col("a.body")
    language = F.when(F.col("a.type") == "code_block", F.coalesce(F.nullif(F.lower("a.hint"), F.lit("")), C.detect_language(body))).when(F.col("a.type") == "config", "json")
    sha = F.substring(F.sha2(F.concat(F.col("session_id").cast("string"), F.lit(":"), F.col("a.type"), F.lit(":"), F.substring(body, 1, 500)), 256), 1, 32)
    out = out.select("session_id", "msg_idx", "place", "role", F.col("a.type").alias("artifact_type"), body.alias("content"), language.alias("language"), sha.alias("hash"), C.line_count(body).cast("long").alias("line_count"), F.length(body).cast("long").alias("char_count"))
    return first_of(out, ["session_id", "hash"], ["msg_idx", "place"]).drop("place")


def operation_hash(op: Column, session: Column, path: Column, content: Column, old: Column, new: Column) -> Column:
    """The key of a file operation, by which one that is read again is the same."""
    what = F.when(op == "write", content).otherwise(F.concat_ws(":", old, new))
    return F.substring(F.sha2(F.concat_ws(":", session.cast("string"), op, path, what), 256), 1, 32)


def concept_mentions(messages: DataFrame, project: Column) -> DataFrame:
    """Technologies with the first sentence of a message that says what they are for, and all components: project_path, session_id, msg_idx, type, name, description, confidence."""
    long = messages.where(F.length("content") >= 20)
    sentence = lambda tech: C.strip(F.regexp_extract("content", rf"(?i)\b{tech}\b[^.]*(?:for|to|handles?|provides?|enables?)[^.]*\.", 0))
    tech = [F.struct(F.lit("technology").alias("type"), F.lit(t).alias("name"), sentence(t).alias("description"), F.lit(0.8).alias("confidence")) for t in P.TECHNOLOGIES]
    component = r"(?i)(?:The\s+)?(\w+\s+(?:backend|frontend|server|service))\s+(?:handles?|provides?)\s+([^.]+)\."
    parts = F.zip_with(
        F.regexp_extract_all("content", F.lit(component), F.lit(1)), F.regexp_extract_all("content", F.lit(component), F.lit(2)),
        lambda n, d: F.struct(F.lit("component").alias("type"), C.strip(n).alias("name"), C.strip(d).alias("description"), F.lit(0.75).alias("confidence")),
    )
    out = long.select(project.alias("project_path"), "session_id", "msg_idx", F.posexplode(F.concat(F.array(*tech), parts)).alias("at", "c"))
    return out.select("project_path", "session_id", "msg_idx", "at", "c.*").where("name <> '' and description <> ''")


def concepts(messages: DataFrame, project: Column) -> DataFrame:
    """Concepts of a project with their first description: project_path, type, name, description, frequency, confidence, source_sessions."""
    order = F.struct("session_id", "msg_idx", "at")
    return concept_mentions(messages, project).groupBy("project_path", "type", "name").agg(
        F.min_by("description", order).alias("description"), F.count("*").alias("frequency"), F.max("confidence").alias("confidence"), F.count_distinct("session_id").alias("sessions")
    )


def knowledge(found: DataFrame) -> DataFrame:
    """Concepts of a project by kind: project_path and a list each of components, technologies, integrations, patterns, facts and rules."""
    kinds = {"component": "components", "technology": "technologies", "integration": "integrations", "pattern": "patterns", "fact": "facts", "rule": "rules"}
    entry = F.struct((-F.col("confidence")).alias("c"), (-F.col("frequency")).alias("f"), "name", "description", "confidence")
    shown = lambda e: F.struct(e["name"].alias("name"), e["description"].alias("description"), e["confidence"].alias("confidence"))
    return found.groupBy("project_path").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == k, entry))), shown).alias(v) for k, v in kinds.items()])


def facts(messages: DataFrame, most: int = 10) -> DataFrame:
    """Key facts in assistants' messages by priority: session_id, msg_idx, fact, priority, rank. Of a pattern, the first three of a message count."""
    # the patterns try every letter of a text as a beginning, so only texts that hold one of their words are given to them
    within = lambda n, found: F.when(C.any_of(F.lower("content"), P.FACT_WORDS[n]), found) if n in P.FACT_WORDS else found
    patterns = [(within(n, F.slice(F.regexp_extract_all("content", F.lit(p), F.lit(1)), 1, 3)), F.struct(F.lit(n).alias("priority"))) for n, p in P.FACT_PATTERNS]
    out = _found(messages.where("role = 'assistant'"), patterns)
    out = out.select("session_id", "msg_idx", "pattern", "match", "extra.priority", C.squeeze(F.col("found")).alias("fact")).where("length(fact) between 20 and 200")
    fact = F.col("fact")
    out = out.where(~C.any_of(fact, P.NO_FACT_SIGNS) & ~F.regexp_like(fact, F.lit("(?i)" + "|".join(P.NO_FACTS))) & ~C.starts_with_any(F.lower(fact), P.NO_FACT_STARTS) & (C.letter_share(fact) >= 0.7))
    out = first_of(out.withColumn("_key", F.lower(F.substring("fact", 1, 50))), ["session_id", "_key"], ["msg_idx", "pattern", "match"])
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("priority"), "msg_idx", "pattern", "match"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("session_id", "msg_idx", "fact", "priority", "rank")


def accomplishments(messages: DataFrame, most: int = 10) -> DataFrame:
    """What assistants say they got done: session_id, msg_idx, kind, text, rank; the first ten of a session, equal beginnings once."""
    patterns = [(F.regexp_extract_all("content", F.lit(p), F.lit(1)), F.struct(F.lit(kind).alias("kind"))) for p, kind in P.ACCOMPLISHMENT_PATTERNS]
    out = _found(messages.where("role = 'assistant'"), patterns)
    out = out.select("session_id", "msg_idx", "pattern", "match", "extra.kind", C.strip(F.col("found")).alias("text")).where("length(text) between 5 and 100")
    out = first_of(out.withColumn("_key", F.substring(F.lower("text"), 1, 50)), ["session_id", "_key"], ["msg_idx", "pattern", "match"])
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx", "pattern", "match"))
    raised = F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 1 << 30))
    shown = F.when((F.col("kind") == "test") & F.regexp_like("text", F.lit(r"^\d+$")), F.concat("text", F.lit(" tests passed"))).when(F.col("kind") == "release", F.concat(F.lit("Released v"), "text")).when(F.col("kind") == "commit", F.col("text")).otherwise(raised)
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("session_id", "msg_idx", "kind", shown.alias("text"), "rank")


def keywords(messages: DataFrame, most: int = 50, files: DataFrame | None = None) -> DataFrame:
    """Keywords of each session: session_id, term, n, rank; the most frequent first.

    File extensions, error words, packages, the first 20 functions of the session, frequent words, and the names of ``files``
    (session_id, file_path) that it touched, without folder and extension, unless they are there already.
    """
    found = lambda p, g=1: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    package = F.transform(found(P.PACKAGE), lambda x: F.split_part(x, F.lit("/"), F.lit(1)))
    special = F.concat(found(P.FILE_EXTENSION), found(P.ERROR_WORD), package)
    terms = messages.select("session_id", F.explode(F.transform(special, F.lower)).alias("term"))
    named = messages.select("session_id", "msg_idx", F.posexplode(F.slice(found(P.FUNCTION_NAME), 1, 20)).alias("at", "term"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx", "at"))
    functions = named.withColumn("place", place).where("place <= 20 and length(term) > 2").select("session_id", F.lower("term").alias("term"))
    from mnemospark.operators.sessions import keyword_counts

    counted = terms.unionByName(functions).groupBy("session_id", "term").agg(F.count("*").alias("n"))
    both = counted.unionByName(keyword_counts(messages).select("session_id", "term", "n")).groupBy("session_id", "term").agg(F.max("n").alias("n"))
    if files is not None:
        name = F.element_at(F.split("file_path", "/"), -1)
        base = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
        touched = files.where(F.length(name) > 2).select("session_id", F.lower(base).alias("term")).distinct().withColumn("n", F.lit(0).cast("long"))
        both = both.unionByName(touched.join(both, ["session_id", "term"], "left_anti"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "term"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def zone_mentions(messages: DataFrame) -> DataFrame:
    """Files that messages name as trouble: session_id, msg_idx, ts, path_pattern, context (50 characters around its first place)."""
    paths = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in P.ZONE_PATTERNS])
    quiet = reduce(lambda a, b: a | b, [F.regexp_like("content", F.lit(f"(?i){p}")) for p in P.NO_ZONE_MESSAGES])
    out = messages.where(~quiet).select("session_id", "msg_idx", "ts", "content", F.explode(paths).alias("found")).withColumn("path_pattern", F.regexp_replace(C.strip(F.col("found")), "^`+|`+$", ""))
    out = out.where(F.length("path_pattern").between(5, 100) & F.regexp_like("path_pattern", F.lit(P.ZONE_EXTENSIONS)))
    at = F.position(F.lower("path_pattern"), F.lower("content"))
    before = F.regexp_extract(F.substring("content", F.lit(1), at - 1), ".{0,50}$", 0)
    after = F.regexp_extract(F.substring(F.col("content"), at + F.length("path_pattern"), F.lit(50)), "^.{0,50}", 0)
    return out.select("session_id", "msg_idx", "ts", "path_pattern", F.substring(F.concat(before, F.substring("content", at, F.length("path_pattern")), after), 1, 200).alias("context"))


def danger_zones(messages: DataFrame, least: int = 1) -> DataFrame:
    """Files that messages name as trouble: path_pattern, issue_count, last_seen, description (the context of the last)."""
    out = zone_mentions(messages).groupBy("path_pattern").agg(F.count("*").alias("issue_count"), F.max("ts").alias("last_seen"), F.max_by("context", F.struct("ts", "session_id", "msg_idx", "context")).alias("description"))
    return out.where(F.col("issue_count") >= least)


def shown_zones(zones: DataFrame) -> DataFrame:
    """Zones with a description that is no fragment of code or of a list."""
    fragment = C.any_of(F.col("description"), ["`", "- ", '":', "line "])
    plain = F.concat(F.lit("Had "), F.col("issue_count").cast("string"), F.lit(" issues in past sessions"))
    return zones.withColumn("description", F.when(fragment, plain).otherwise(F.col("description")))
