"""What messages say of their user: names, preferences, rules, ways of working, prerequisites."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import gates as G
from mnemospark.functions import patterns as P
from mnemospark.operators import folding
from mnemospark.operators.staging import materialise

ORDER = ("session_id", "msg_idx")
LATEST = 64


# --- names -----------------------------------------------------------------------------------------------------------
def _is_name(name: Column, blocked: list[str]) -> Column:
    return F.regexp_like(name, F.lit("^[A-Z][a-z]{2,14}$")) & ~F.lower(name).isin(blocked)


def name_candidates(messages: DataFrame, blocked: list[str] | None = None, products: list[str] | None = None) -> DataFrame:
    """Names that users give themselves: session_id, name, pattern, confidence.

    The first pattern of a message that gives a name counts. A sign-off counts only in the first message of a session that
    names anybody. A session keeps for each name the best confidence and its last pattern. ``blocked``: words that are no
    names, by default those of conversation, technologies, stopwords and words of other domains; ``products``: more of them.
    """
    blocked = blocked if blocked is not None else sorted({*P.NO_NAMES, *P.TECHNOLOGIES, *P.FUZZY_STOPWORDS, *P.FILTER_WORDS})
    blocked = [*blocked, *(p.lower() for p in products or [])]
    pick = lambda text, p, kind, c: F.when(_is_name(F.regexp_extract(text, p, 1), blocked), F.struct(F.regexp_extract(text, p, 1).alias("name"), F.lit(kind).alias("pattern"), F.lit(c).alias("confidence")))
    intro = F.coalesce(*[pick(F.col("content"), *p) for p in P.NAME_PATTERNS])
    tail = F.when(F.length("content") > 100, F.substring("content", -100, 100)).otherwise(F.col("content"))
    said = messages.where((F.col("role") == "user") & (F.length("content") >= 10)).select(*ORDER, intro.alias("intro"), pick(tail, *P.SIGN_OFF).alias("off")).where("intro is not null or off is not null")
    first = F.min("msg_idx").over(Window.partitionBy("session_id")) == F.col("msg_idx")
    found = said.withColumn("f", F.coalesce("intro", F.when(first, F.col("off")))).where("f is not null")
    return found.groupBy("session_id", F.col("f.name").alias("name")).agg(F.max_by("f.pattern", "msg_idx").alias("pattern"), F.max("f.confidence").alias("confidence"))


def name_scores(candidates: DataFrame) -> DataFrame:
    """Names by sum of confidences, best pattern and number of sessions."""
    weight = F.coalesce(*[F.when(F.col("pattern") == k, w) for k, w in P.NAME_WEIGHTS.items()], F.lit(P.OTHER_NAME_WEIGHT))
    out = candidates.groupBy("name").agg(F.sum("confidence").alias("total"), F.count_distinct("session_id").alias("sessions"), F.max(weight).alias("weight"))
    return out.select("name", "sessions", F.round(F.col("total") * F.col("weight") + F.log(F.col("sessions") + 1.0), 4).alias("score"))


# --- preferences -----------------------------------------------------------------------------------------------------
def _found(messages: DataFrame, matches: Column, *more: Column) -> DataFrame:
    """A row a match; ``matches`` is an array of structs with a field ``place``, its pattern's number."""
    return messages.select(*ORDER, *more, F.posexplode(matches).alias("at", "f")).select(*ORDER, *[F.col(c) for c in messages.select(*more).columns], "at", "f.*")


def _of_pattern(text: Column, i: int, pattern: str, group: int, **extra) -> Column:
    constant = [F.lit(v).alias(k) for k, v in extra.items()]
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.struct(F.lit(i).alias("place"), *constant, C.strip(m).alias("found")))


def preferences(messages: DataFrame, patterns: list[tuple[str, str, float]] | None = None, noise: list[str] | None = None, filtered: list[str] | None = None) -> DataFrame:
    """Preferences of user messages: category, preference, frequency, sessions, confidence.

    The first sighting gives the confidence, each further one adds a tenth. Messages with a word of ``noise`` tell
    nothing; preferences with a word of ``filtered`` are none.
    """
    patterns, noise, filtered = patterns or P.PREFERENCE_PATTERNS, P.PREFERENCE_NOISE if noise is None else noise, P.FILTER_WORDS if filtered is None else filtered
    text = F.lower("content")
    matches = F.concat(*[_of_pattern(text, i, p, 1, category=c, confidence=s) for i, (c, p, s) in enumerate(patterns)])
    out = _found(messages.where((F.col("role") == "user") & ~C.any_of(text, noise)), matches).withColumnRenamed("found", "preference")
    out = out.where(F.length("preference").between(3, 50) & ~C.any_of(F.col("preference"), [*filtered, "**", "`", "("]))
    first = F.min_by("confidence", F.struct(*ORDER, "at"))
    out = out.groupBy("category", "preference").agg(F.count("*").alias("frequency"), F.count_distinct("session_id").alias("sessions"), first.alias("first"))
    return out.select("category", "preference", "frequency", "sessions", F.round(F.least(F.lit(1.0), F.col("first") + 0.1 * (F.col("frequency") - 1)), 4).alias("confidence"))


def is_approval(preference: Column) -> Column:
    return F.lower(C.strip(preference)).isin(P.APPROVALS)


# --- rules -----------------------------------------------------------------------------------------------------------
def _rule_matches(i: int, kind: str, pattern: str, confidence: float, conditional: bool) -> Column:
    """All matches of a pattern; of two captures, a conditional rule's first is its scope, and alternatives are joined."""
    found = lambda group: F.regexp_extract_all("content", F.lit(pattern), F.lit(group))

    def shape(text: Column, own: Column) -> Column:
        return F.struct(F.lit(i).alias("place"), F.lit(kind).alias("rule_type"), F.lit(confidence).alias("confidence"), C.strip(text).alias("rule_text"), own.alias("own"))

    if conditional:
        return F.zip_with(found(1), found(2), lambda scope, rule: shape(rule, C.strip(scope)))
    none = F.lit(None).cast("string")
    if pattern.count("([a-zA-Z0-9_-]+)") == 2:
        return F.zip_with(found(1), found(2), lambda a, b: shape(F.concat(a, F.lit(" over "), b), none))
    return F.transform(found(1), lambda m: shape(m, none))


def rules(messages: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Rules that users state, with false ones left out: session_id, msg_idx, at, rule_type, rule_text, scope, confidence."""
    noise = P.RULE_NOISE if noise is None else noise
    plain = [_rule_matches(i, *rule, conditional=i >= len(P.RULE_PATTERNS)) for i, rule in enumerate([*P.RULE_PATTERNS, *P.CONDITIONAL_PATTERNS])]
    user = messages.where((F.col("role") == "user") & ~C.any_of(F.lower("content"), noise))
    out = _found(user, F.concat(*plain), F.col("content"))
    out = out.where(~G.states_no_rule(F.col("content"), F.col("rule_text")))
    return out.select(*ORDER, "at", "rule_type", F.substring("rule_text", 1, 200).alias("rule_text"), F.coalesce("own", F.when(F.col("place") < len(P.RULE_PATTERNS), G.scope(F.col("content")))).alias("scope"), "confidence")


def revocations(messages: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """What users say no longer holds: session_id, msg_idx, at, words."""
    noise = P.RULE_NOISE if noise is None else noise
    text = F.lower("content")
    matches = F.concat(*[_of_pattern(text, i, p, 1) for i, p in enumerate(P.REVOCATION_PATTERNS)])
    out = _found(messages.where((F.col("role") == "user") & ~C.any_of(text, noise)), matches)
    out = out.withColumn("words", F.array_distinct(G.rule_words(F.col("found"))))
    return out.where(F.length(G.normalised_rule(F.col("found"))) >= 5).select(*ORDER, "at", "words")


def rule_frequencies(found: DataFrame) -> DataFrame:
    """Equal rules as one, with the accumulated confidence."""
    out = found.groupBy("rule_type", F.lower("rule_text").alias("rule_text")).agg(F.count("*").alias("frequency"), F.max("confidence").alias("c"))
    return out.select("rule_type", "rule_text", "frequency", F.round(F.least(F.lit(1.0), F.col("c") + 0.05 * (F.col("frequency") - 1)), 4).alias("confidence"))


def similar_sets(sets: DataFrame, least: float = 0.7, digits: int | None = 4) -> DataFrame:
    """Pairs of different word sets of one kind (id, kind, words) with at least this Jaccard similarity: a, b, similarity.

    Sets this similar have a word in common among the first ``n - ceil(least * n) + 1`` of each in order of frequency, and
    sizes within the same bound. A pair is formed at its first common word only, where the rest of both sets can still
    reach the overlap, and checked there, so that no pair is shuffled before it is one.
    """
    counts = sets.select("kind", F.explode("words").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("df"))
    ranked = sets.select("id", "kind", F.explode("words").alias("word")).join(counts, ["kind", "word"])
    order = ranked.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("df", "word")))["word"].alias("o")).withColumn("n", F.size("o"))
    first = order.select("id", "kind", "n", "o", F.posexplode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("i", "word"))
    other = first.select(F.col("id").alias("b"), "kind", F.col("n").alias("nb"), F.col("o").alias("ob"), F.col("i").alias("ib"), "word")
    pairs = first.withColumnRenamed("id", "a").join(other, ["kind", "word"]).where("a < b").where(F.least("n", "nb") >= F.greatest("n", "nb") * least - 1e-9)
    overlap = F.ceil((F.col("n") + F.col("nb")) * least / (1 + least) - 1e-9)
    pairs = pairs.where(1 + F.least(F.col("n") - F.col("i") - 1, F.col("nb") - F.col("ib") - 1) >= overlap)
    met = F.size(F.array_intersect(F.slice("o", F.lit(1), F.col("i")), F.slice("ob", F.lit(1), F.col("ib")))) == 0
    found = pairs.where(met).withColumn("similarity", C.jaccard(F.col("o"), F.col("ob")))
    return found.where(F.col("similarity") >= least).select("a", "b", (F.col("similarity") if digits is None else F.round("similarity", digits)).alias("similarity"))


def similar_pairs(texts: DataFrame, key: str, text: str, least: float = 0.7) -> DataFrame:
    """Pairs of different texts whose word sets have at least this Jaccard similarity; texts with equal sets are one class."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")))
    sets = texts.select(F.col(key).alias("id"), words.alias("words")).where(F.size("words") > 0).groupBy("words").agg(F.min("id").alias("id"))
    return similar_sets(sets.withColumn("kind", F.lit("")), least)


def learned_rules(found: DataFrame, revoked: DataFrame, least: float = 0.7, revoking: float = 0.5, block: int = folding.BLOCK) -> DataFrame:
    """Rules folded in order of statement into similar ones of their type that hold, and revoked when users take them back.

    A rule joins the kept one it resembles most, by Jaccard similarity of its words from ``least`` on (the earlier of equals),
    and strengthens it; a revocation ends those that have at least ``revoking`` of their words in it, and a later statement
    starts anew. Statements of one wording between two revocations of it or of a similar wording have one fate: the first
    starts a rule or joins one, which then takes the others too. So only the first of each such span is folded
    (``folding.first_come``, in rounds); the others find the best rule alive by joins, and counts are sums. Of one place (session, message, number of
    the match) a revocation comes after a statement. Statements without a word that counts or a type are none.
    """
    place = F.struct(*ORDER, "at")
    stated = found.select(place.alias("place"), F.col("rule_type").alias("kind"), "rule_text", "scope", F.col("confidence").cast("double").alias("confidence"), F.array_sort(F.array_distinct(G.rule_words(F.col("rule_text")))).alias("words"))
    stated = materialise(stated.where((F.size("words") > 0) & F.col("kind").isNotNull()), "said")
    sets = materialise(stated.select("kind", "words").distinct().select("kind", "words", F.monotonically_increasing_id().alias("id")), "wordings")
    stated = materialise(stated.join(sets, ["kind", "words"]).drop("words"), "stated")
    pairs = similar_sets(sets, least, None)
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    near = materialise(near.unionByName(sets.select("id", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))), "near")

    # a wording of n words that shares half of them with a revocation shares one of its n - ceil(n / 2) + 1 first; equal revocations go as one
    some = sets.select("id", "words", F.explode(F.slice("words", F.lit(1), F.size("words") - F.ceil(F.size("words") * revoking).cast("int") + 1)).alias("word"))
    ended = materialise(revoked.select(place.alias("place"), F.array_sort(F.array_distinct("words")).alias("gone")), "revoked")
    texts = ended.select("gone").distinct()
    met = some.join(texts.select("gone", F.explode("gone").alias("word")), "word").where(F.size(F.array_intersect("words", "gone")) >= revoking * F.size("words"))
    ends = materialise(met.select("id", "gone").distinct().join(ended, "gone").select("id", "place").distinct(), "ends")
    cuts = ends.withColumnRenamed("id", "other").join(near, "other").select("id", "place")

    # the first statement of each span, and where a rule that it starts would end
    spans = _spans(stated, cuts)
    firsts = spans.groupBy("id", "span").agg(F.min("place").alias("first"))
    asked = firsts.select("id", F.col("first").alias("place"), F.lit(0).alias("side")).unionByName(ends.select("id", "place", F.lit(1).alias("side")))
    counted = materialise(folding.running_count(asked, "id", ["place", "side"], F.col("side") == 1, "n"), "asked")
    stop = counted.where("side = 1").select("id", "n", F.col("place").alias("end"))
    nodes = counted.where("side = 0").withColumn("n", F.col("n") + 1).join(stop, ["id", "n"], "left").select("id", F.col("place").alias("first"), "end")
    rules_ = folding.first_come(materialise(nodes, "firsts"), near.select("id", "other"), block)
    rules_ = materialise(rules_.select("id", "born", "end", F.monotonically_increasing_id().alias("rule")), "rules")

    # every statement goes to the most similar rule alive, of which there may be a new one since its span's beginning
    births = rules_.select(F.col("id").alias("other"), F.col("born").alias("place")).join(near.where("id <> other"), "other").select("id", "place")
    spans = _spans(stated, cuts.unionByName(births))
    firsts = spans.groupBy("id", "span").agg(F.min("place").alias("first"))
    alive = folding.latest_alive(firsts.join(near, "id"), rules_)
    best = alive.groupBy("id", "span").agg(F.min_by("rule", F.struct(-F.col("similarity"), "born")).alias("rule"))
    joined = materialise(spans.join(best, ["id", "span"]).select("rule", "id", "place", "confidence", "rule_text", "scope"), "joined")

    # in order of statement, c = min(1, max(c, own) + 0.05), so in the end the largest of own plus 0.05 for each statement from it on
    at = joined.groupBy("rule", "place").agg(F.count("*").alias("k"), F.max("confidence").alias("own"))
    ranked = folding.running_count(at, "rule", ["place"], F.col("k"), "through")
    level = F.col("own") - F.lit(0.05) * (F.col("through") - F.col("k") + F.when(F.col("through") == F.col("k"), 1).otherwise(0))
    whole = ranked.groupBy("rule").agg(F.sum("k").alias("frequency"), F.min("place").alias("born"), F.max("place").alias("last"), F.max(level).alias("level"))
    whole = whole.withColumn("confidence", F.least(F.lit(1.0), F.col("level") + F.lit(0.05) * F.col("frequency"))).drop("level")
    heads = joined.join(rules_.select("rule", "id", F.col("born").alias("place")), ["rule", "id", "place"]).groupBy("rule", "id").agg(F.min("rule_text").alias("rule_text"), F.min("scope").alias("scope"))
    out = whole.join(heads, "rule").join(rules_.select("rule", "end"), "rule").join(sets.select("id", F.col("kind").alias("rule_type")), "id")
    seen = lambda p: F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ORDER])
    return out.select("rule_type", "rule_text", "scope", "frequency", "confidence", seen("born").alias("first_seen"), seen("last").alias("last_seen"), F.col("end").isNotNull().alias("revoked"))


def _spans(stated: DataFrame, cuts: DataFrame) -> DataFrame:
    """Statements with the number of cuts of their wording (id, place) before them; a cut at a statement's place comes after it."""
    marks = cuts.select("id", "place").distinct().select("id", "place", F.lit(1).alias("side"), *[F.lit(None).cast(stated.schema[c].dataType).alias(c) for c in stated.columns if c not in ("id", "place")])
    both = stated.withColumn("side", F.lit(0)).unionByName(marks)
    return folding.running_count(both, "id", ["place", "side"], F.col("side") == 1, "span").where("side = 0").drop("side")


def decayed_rules(found: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    out = found.withColumn("effective", C.rule_decay(C.age_days(F.col("last_seen"), as_of), F.col("confidence"), F.col("frequency")))
    return out if limit is None else out.orderBy(F.desc("frequency"), F.desc("confidence"), "rule_text").limit(limit)


# --- ways of working -------------------------------------------------------------------------------------------------
def lifecycle(messages: DataFrame) -> DataFrame:
    """How users go about their work, from where each phase first comes up: session_id, sequence, confidence."""
    user = messages.where("role = 'user'").withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx")) - 1)
    text = F.lower("content")
    first = [F.min(F.when(C.any_of(text, words), F.col("at"))).alias(phase) for phase, words in P.LIFECYCLE_SIGNALS]
    out = user.groupBy("session_id").agg(F.count("*").alias("n"), *first).where("n >= 3")
    names = {"plan": "Plan", "test_first": "Write Tests", "implement": "Implement", "test_after": "Test", "commit": "Commit"}
    usable = {p: F.col(p).isNotNull() & ((F.col(p) > 1) & (F.col(p) <= F.col("n") * 0.8) if p == "commit" else F.lit(True)) for p in names}
    phases = F.array(*[F.when(usable[p], F.struct(F.col(p).alias("at"), F.lit(i).alias("order"), F.lit(p).alias("phase"))) for i, (p, _) in enumerate(P.LIFECYCLE_SIGNALS) if p in names])
    chosen = F.slice(F.array_sort(F.filter(phases, lambda p: p.isNotNull())), 1, 4)["phase"]
    out = out.withColumn("phases", chosen).where(F.size("phases") >= 2)
    has = lambda p, w: F.when(F.array_contains("phases", p), w).otherwise(0.0)
    confidence = F.least(F.size("phases") / 4.0, F.lit(1.0)) * 0.55 + F.when(F.element_at("phases", 1) == "plan", 0.2).otherwise(0.0) + has("test_first", 0.15) + has("commit", 0.1)
    named = F.array_join(F.transform("phases", lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), p)), " -> ")
    return out.select("session_id", named.alias("sequence"), F.round(F.least(confidence, F.lit(1.0)), 2).alias("confidence"))


def session_patterns(messages: DataFrame) -> DataFrame:
    """What each session of at least three user messages says of its user's way of working: session_id, pattern_type, description, confidence."""
    user = F.col("role") == "user"
    at = F.sum(user.cast("int")).over(Window.partitionBy("session_id").orderBy("msg_idx"))
    text = F.lower("content")
    m = messages.withColumn("at", F.when(user, at))
    opening = F.array_join(F.array_sort(F.collect_list(F.when(F.col("at") <= 3, F.struct("at", F.lower(F.substring("content", 1, 200)).alias("t")))))["t"], " ")
    per = m.groupBy("session_id").agg(F.count("at").alias("n"), F.count_if(F.contains(text, F.lit("edit"))).alias("edits"), opening.alias("opening"), F.max(F.when(F.col("at") == 1, F.substring(text, 1, 100))).alias("first")).where("n >= 3")
    hits = [F.col("edits") > 3, C.any_of(F.col("opening"), P.EARLY_TESTS), C.any_of(F.col("opening"), P.EARLY_PLANS), C.any_of(F.col("first"), P.DIRECT_WORDS)]
    found = F.filter(F.array(*[F.when(h, F.lit(d)) for h, d in zip(hits, P.WORK_PATTERNS, strict=True)]), lambda d: d.isNotNull())
    workflow = per.select("session_id", F.explode(found).alias("description")).select("session_id", F.lit("workflow").alias("pattern_type"), "description", F.lit(0.5).alias("confidence"))
    cycle = lifecycle(messages).where("confidence >= 0.3").select("session_id", F.lit("lifecycle").alias("pattern_type"), F.col("sequence").alias("description"), "confidence")
    return workflow.unionByName(cycle)


def work_patterns(found: DataFrame) -> DataFrame:
    """Patterns over all sessions: pattern_type, description, frequency, confidence.

    The confidence of a lifecycle is the running mean of old and new plus 0.05, at most 1, session by session. As the
    weight of a session halves with every later one, the last ``LATEST`` give it to the last bit of a double; they are
    found in two steps, so that a pattern of very many sessions is no hot group.
    """
    latest = lambda *key: F.row_number().over(Window.partitionBy("pattern_type", "description", *key).orderBy(F.desc("session_id")))
    some = found.withColumn("salt", F.pmod(F.xxhash64("session_id"), F.lit(64))).withColumn("late", latest("salt")).where(F.col("late") <= LATEST).withColumn("late", latest())
    listed = some.where(F.col("late") <= LATEST).groupBy("pattern_type", "description").agg(F.array_sort(F.collect_list(F.struct("session_id", "confidence")))["confidence"].alias("c"))
    out = found.groupBy("pattern_type", "description").agg(F.count("*").alias("frequency")).join(listed, ["pattern_type", "description"])
    folded = F.aggregate(F.slice("c", 2, 1 << 30), F.element_at("c", 1), lambda s, x: F.least(F.lit(1.0), (s + x) / 2 + 0.05))
    return out.select("pattern_type", "description", "frequency", F.when(F.col("pattern_type") == "lifecycle", folded).otherwise(F.element_at("c", 1)).alias("confidence"))


def best_lifecycle(patterns: DataFrame, last_seen: str, as_of: Column) -> DataFrame:
    """The lifecycle with the highest product of frequency, confidence and recency, as one row at most."""
    age = C.age_days(F.col(last_seen), as_of)
    score = F.col("frequency") * F.col("confidence") * F.when(age <= 7, 2.0).when(age <= 30, 1.5).otherwise(1.0)
    return patterns.where("pattern_type = 'lifecycle' and confidence >= 0.5").withColumn("score", score).orderBy(F.desc("score"), "description").limit(1)


# --- zones and prerequisites -----------------------------------------------------------------------------------------
def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def zones_of_files(files: DataFrame, zones: DataFrame, path: str = "file_path") -> DataFrame:
    """Files whose path holds a zone's pattern anywhere, whatever the case: the file's columns, path_pattern, issue_count.

    A path that holds a pattern holds each run of four characters of it (a shorter pattern as a whole). Distinct paths and
    patterns meet on the one of the pattern's runs that the fewest paths have, then the whole pattern is looked for.
    """
    low = F.lower("path_pattern")
    runs = F.coalesce(F.when(F.length(low) >= 4, _grams(low, 4)), F.array(low))
    z = zones.where("path_pattern <> ''").select("path_pattern", "issue_count", F.explode(F.array_distinct(runs)).alias("gram"))
    whole = F.lower(F.col(path))
    grams = F.array_distinct(reduce(lambda a, b: F.concat(a, b), [_grams(whole, n) for n in (1, 2, 3, 4)]))
    paths = files.select(path).distinct().select(F.col(path), whole.alias("whole"), F.explode(grams).alias("gram"))
    counts = paths.join(z.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = z.join(counts, "gram", "left").groupBy("path_pattern", "issue_count").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    met = paths.join(rarest, "gram").where(F.contains("whole", F.lower("path_pattern"))).select(path, "path_pattern", "issue_count")
    return files.join(met, path)


def zone_alerts(zones: DataFrame, recent_files: DataFrame, path: str = "file_path") -> DataFrame:
    """Zones that a recently changed file touches, each once."""
    touched = zones_of_files(recent_files.select(path).distinct(), zones, path).select("path_pattern").distinct()
    return zones.join(touched, "path_pattern", "left_semi")


def statements(messages: DataFrame) -> DataFrame:
    """Prerequisites that messages state: session_id, msg_idx, at, environment, action, command, reason, service, confidence."""
    text, lower = F.col("content"), F.lower("content")
    pairs = [F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda a, b: F.struct(C.strip(a).alias("a"), C.strip(b).alias("b"))) for p in P.PREREQUISITE_PATTERNS]
    m = messages.where((F.length("content") >= 20) & C.any_of(lower, P.PREREQUISITE_WORDS))
    found = m.select(*ORDER, "role", "content", F.posexplode(F.concat(*pairs)).alias("at", "f")).where("f.a <> '' and f.b <> ''")
    shorter = F.length("f.a") < F.length("f.b")
    env, action = F.when(shorter, F.col("f.a")).otherwise(F.col("f.b")), F.when(shorter, F.col("f.b")).otherwise(F.col("f.a"))
    found = found.select(*ORDER, "at", "role", "content", F.lower(env).alias("environment"), action.alias("action"))
    found = found.where(F.length("action").between(5, 200) & F.length("environment").between(2, 40) & G.is_prerequisite(F.col("environment"), F.col("action")))
    first = lambda p: C.strip(F.regexp_extract("content", p, 1))
    command = F.coalesce(*[F.when((F.length(first(p)) > 3) & (F.length(first(p)) < 500), first(p)) for p in P.PREREQUISITE_COMMANDS])
    reason = F.coalesce(*[F.when(F.regexp_like("content", F.lit(p)), first(p)) for p in P.PREREQUISITE_REASONS])
    found = found.withColumn("command", command).withColumn("reason", reason)
    both = F.concat_ws("\n", F.lower("action"), F.lower("command"))
    service = F.coalesce(*[F.when(F.contains(both, F.lit(s)), F.lit(s)) for s in P.CHECKED_SERVICES])
    has = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    confidence = 0.5 + F.when(F.col("role") == "user", 0.15).otherwise(0.0) + has("command", 0.10) + has("service", 0.05) + has("reason", 0.05)
    return found.withColumn("service", service).withColumn("confidence", confidence).drop("role", "content")


def prerequisites(stated: DataFrame) -> DataFrame:
    """One row an environment and action: frequency, first confidence plus a tenth a repetition, latest known command, reason and service."""
    place = F.struct(*ORDER, "at")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    out = stated.groupBy("environment", "action").agg(F.count("*").alias("frequency"), F.min_by("confidence", place).alias("first"), last("command"), last("reason"), last("service"))
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("first") + 0.1 * (F.col("frequency") - 1)), 4)).drop("first")


def applicable(found: DataFrame, environments: list[str]) -> DataFrame:
    """Prerequisites for an environment: equal, one within the other, or for all."""
    env = F.lower("environment")
    hit = env.isin("all", "always", "any", "everywhere")
    for e in environments:
        hit = hit | F.contains(env, F.lit(e.lower())) | F.contains(F.lit(e.lower()), env)
    return found.where(hit)


def prerequisite_alerts(found: DataFrame, environments: list[str]) -> DataFrame:
    """Alerts for the prerequisites of an environment that are sure enough and not suppressed; commands to check them are not run."""
    sure = found.where("confidence >= 0.5")
    if "suppressed" in found.columns:
        sure = sure.where("not coalesce(suppressed, false)")
    priority = F.when(F.col("confidence") > 0.75, "high").otherwise("medium")
    return applicable(sure, environments).select(
        F.lit("prerequisite").alias("type"), priority.alias("priority"), F.col("action").alias("message"), "environment",
        F.when(F.col("command") != "", F.concat(F.lit("Run: "), "command")).alias("suggestion"), F.col("reason").alias("context"), "confidence", "frequency",
    )


# --- tasks and vectors -----------------------------------------------------------------------------------------------
def _bigrams(t: str) -> set[str]:
    return {t[i : i + 2] for i in range(len(t) - 1)}


def _forms(t: str) -> tuple[str, set[str], set[str]]:
    return t, set(t.split()), _bigrams(t)


def _alike(a: str, b: str) -> float:
    """As ``columns.text_similarity``, of texts in lower case with single spaces."""
    return _likeness(_forms(a), _forms(b))


def _likeness(a: tuple, b: tuple) -> float:
    if not a[0] or not b[0]:
        return 0.0
    if a[0] == b[0]:
        return 1.0
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    return max(share(a[1], b[1]), share(a[2], b[2]))


def distinct_tasks(tasks: DataFrame, least: float = 0.5, key: str = "session_id") -> DataFrame:
    """Tasks of a session, or of another ``key``, in groups of similar ones, the shortest of each: key, task, n, place.

    Groups depend on order; each key is folded on its own, and tasks that compare equal are one before. Keys stream through a
    task in order, as a frame for each of very many small ones takes longer than its fold.
    """
    once = tasks.groupBy(key, G.task_key(F.col("task")).alias("norm")).agg(F.min_by("task", F.struct(F.length("task"), "place")).alias("task"), F.min("place").alias("place"), F.count("*").alias("n"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = None, []  # of a group: the forms of the first one's comparison text, place, count, shortest
        for batch in batches:
            done = []
            for own, norm, task, place, n in zip(*(batch.column(c).to_pylist() for c in ("own", "norm", "task", "place", "n")), strict=True):
                if groups and own != now:
                    done += [(now, g) for g in groups]
                    groups = []
                now, forms = own, _forms(norm)
                for group in groups:
                    if norm.startswith(group[0][0][:35]) or group[0][0].startswith(norm[:35]) or _likeness(forms, group[0]) > least:
                        group[2] += n
                        group[3] = min(group[3], task, key=len)
                        break
                else:
                    groups.append([forms, place, n, task])
            types = [batch.schema.field(c).type for c in ("own", "place")]
            yield folded(done, *types)
        if groups:
            yield folded([(now, g) for g in groups], *types)

    def folded(done: list[tuple], of: pa.DataType, at: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in done], of), pa.array([g[3] for _, g in done], pa.string()), pa.array([g[2] for _, g in done], pa.int64()), pa.array([g[1] for _, g in done], at)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "task", "n", "place"])

    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema.fields}
    ordered = once.withColumnRenamed(key, "own").repartition("own").sortWithinPartitions("own", "place")
    return ordered.mapInArrow(fold, f"{key} {kinds[key]}, task string, n long, place {kinds['place']}")


def embed(texts: DataFrame, text: str, width: int = 64) -> DataFrame:
    """A deterministic embedding by hashed words, as a stand-in for a model: texts with the column embedding."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        for batch in batches:
            out = np.zeros((len(batch), width), np.float32)
            for row, t in zip(out, batch, strict=True):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    row[h % width] += 1 if h & 0x10000 else -1
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(size > 0, size, 1)))

    return texts.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))
