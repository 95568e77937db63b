"""What a new conversation is told of past ones: recent tasks, topics, decisions, the last session, tips, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import gates as G
from mnemospark.functions import patterns as P
from mnemospark.operators import profile


def of_project(sessions: DataFrame, project: str) -> DataFrame:
    """Sessions whose project holds the path or is held by it."""
    path = F.col("project_path")
    return sessions.where(F.contains(path, F.lit(project)) | F.contains(F.lit(project), path))


def newest(sessions: DataFrame, limit: int, key: list[str] | None = None) -> DataFrame:
    """The latest changed sessions (last_modified), of each ``key`` if there is one, with their place."""
    order = Window.partitionBy(*(key or [])).orderBy(F.desc_nulls_last("last_modified"), "session_id")
    if key:
        return sessions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    some = sessions.orderBy(F.desc_nulls_last("last_modified"), "session_id").limit(limit)
    return some.withColumn("place", F.row_number().over(order))  # at most ``limit`` rows


def recent_tasks(sessions: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """Distinct tasks of each ``key``, latest first: key, task, n, rank. ``sessions``: key, place, task_description."""
    kept = lambda t: (t != "") & ~F.startswith(t, F.lit("<command-")) & ~F.startswith(t, F.lit("/"))
    real = sessions.select(key, "place", F.explode(F.filter(F.array("task_description"), kept)).alias("task"))  # one computation of the task; conditions on a column would repeat it
    folded = profile.distinct_tasks(real, key=key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return folded.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "task", "n", "rank")


def shown_tasks(tasks: DataFrame, task: str = "task") -> DataFrame:
    """Tasks that are work, cut to be shown."""
    return tasks.where(G.is_task(F.col(task))).withColumn("shown", G.shown_task(F.col(task)))


def active_topics(sessions: DataFrame, key: str, tasks: DataFrame | None = None, known: list[str] | None = None, limit: int = 3) -> DataFrame:
    """Summaries that are not over, equal beginnings once, without those that repeat a task: key, topic, rank."""
    found = sessions.select(key, "place", F.col("summary").alias("topic")).where(G.is_active(F.col("topic"), known))
    once = Window.partitionBy(key, F.substring(G.task_key(F.col("topic")), 1, 60)).orderBy("place")
    found = found.withColumn("again", F.row_number().over(once)).where("again = 1")
    if tasks is not None:
        echo = found.alias("f").join(tasks.select(F.col(key).alias("k"), F.col("task").alias("t")), F.col(f"f.{key}") == F.col("k")).where(G.same_task(F.col("topic"), F.col("t"))).select(F.col(f"f.{key}").alias(key), "topic")
        found = found.join(echo.distinct(), [key, "topic"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "topic", "rank")


def recent_decisions(facts: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """Facts that are whole sentences, equal beginnings once: key, fact, rank. ``facts``: key, place, at, fact."""
    kept = facts.where(G.is_decision(F.col("fact")))
    once = Window.partitionBy(key, F.substring(G.task_key(F.col("fact")), 1, 60)).orderBy("place", "at")
    kept = kept.withColumn("again", F.row_number().over(once)).where("again = 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place", "at"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "fact", "rank")


def last_session(sessions: DataFrame, scan: int = 20) -> DataFrame:
    """The latest session of real work among the last ``scan``, one row at most: session_id, last_modified, summary, last_task."""
    some = sessions.orderBy(F.desc_nulls_last("last_modified"), "session_id").limit(scan).where(G.is_real_session(F.col("summary"), F.col("task_description")))
    task = F.col("task_description")
    real = (F.length(task) > 20) & ~F.startswith(task, F.lit("/")) & ~C.any_of(task, ["<command-", "</command"])
    return some.orderBy(F.desc_nulls_last("last_modified"), "session_id").limit(1).select("session_id", "last_modified", F.substring(G.plain_summary(F.col("summary")), 1, 200).alias("summary"), F.when(real, F.substring(task, 1, 150)).alias("last_task"))


def structured_decisions(decisions: DataFrame, limit: int = 5) -> DataFrame:
    """Sure decisions that read as such, surest and latest first: decision, category, reasoning. Three times the limit is looked at."""
    some = decisions.where("confidence >= 0.75").orderBy(F.desc("confidence"), F.desc("ts"), "hash").limit(3 * limit)
    reason = F.when((F.length("reasoning") > 15) & ~C.any_of(F.lower("reasoning"), P.NO_SUMMARIES[:5]), F.substring("reasoning", 1, 150))
    kept = some.where(G.is_sound_summary(F.col("decision"))).orderBy(F.desc("confidence"), F.desc("ts"), "hash").limit(limit)
    return kept.select("hash", F.substring("decision", 1, 120).alias("decision"), F.coalesce("category", F.lit("general")).alias("category"), reason.alias("reasoning"))


def rule_tips(rules: DataFrame, per_type: int = 2, most: int = 6) -> DataFrame:
    """Rules to show: per type the first two by place, in the order of types, six in all: rule_type, tip, rank.

    ``rules``: rule_type, rule_text, place. Rules that would be cut badly are left out.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in ("never", "always", "require", "prefer", "avoid", "prohibit", "style")]), F.col("rule_type"))
    names = F.create_map(*[F.lit(x) for kv in P.RULE_NAMES.items() for x in kv])
    shown = G.shown_rule(F.col("rule_text"), 80)
    bad = F.endswith("shown", F.lit("...")) & ((F.length("shown") < 45) | F.regexp_like("shown", F.lit(r" (?:a|an|the|with|to|for|and|or|in|on|by|of|that|this|is)\.\.\.$")))
    first = rules.withColumn("i", F.row_number().over(Window.partitionBy("rule_type").orderBy("place"))).where(F.col("i") <= per_type)
    kept = first.withColumn("shown", shown).where((F.length("rule_text") >= 10) & ~bad).withColumn("o", order)
    rank = F.row_number().over(Window.orderBy("o", "i"))  # two rows a type
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("rule_type", F.concat(names[F.col("rule_type")], F.lit(": "), "shown").alias("tip"), "rank")


def preference_tip(preference: Column) -> Column:
    """What a preference in communication asks of an assistant; null if nothing is known to follow from it."""
    p = F.lower(preference)
    has = lambda *words: C.any_of(p, list(words))
    return (
        F.when(has("concise", "brief"), "Keep answers short").when(has("detailed", "verbose"), "Explain thoroughly").when(has("no emoji"), "No emojis")
        .when(has("code first"), "Code before explanations").when(has("don't ask", "prompt me"), "Go on without asking when the task is clear").when(has("step by step"), "One step at a time")
        .when(has("don't commit", "i'll commit"), "Leave commits to the user").when(has("commit") & has("often", "frequently"), "Commit small and often").when(has("explain"), "Explain the reasoning on the way")
    )


def profile_summary(profile: dict, shown: dict[str, int] | None = None) -> str:
    """A user in a paragraph, from the collected profile: name, sessions, first preference and rules, files to be careful with."""
    name, sessions = profile.get("name") or "Unknown", profile.get("sessions", 0)
    if not sessions:
        return f"New user: {name}. No conversation history yet."
    out = [f"{name} is {'the sole developer' if sessions >= 5 else 'working'} on this project ({sessions} sessions)."]
    talk = [p["preference"] for p in profile.get("preferences", []) if p["category"] == "communication" and p["preference"].lower() not in P.APPROVALS]
    rules = profile.get("rules", {})
    if talk:
        out.append(f"Prefers {talk[0].lower()}.")
    for kind, lead in (("never", "Important: never"), ("always", "Always"), ("require", "Required:")):
        if rules.get(kind) and not (kind == "require" and rules.get("always")):
            out.append(f"{lead} {rules[kind][0]}.")
    if profile.get("danger_zones"):
        out.append("Caution with: " + ", ".join(z["path_pattern"].split("/")[-1] for z in profile["danger_zones"][:2]) + ".")
    return " ".join(out)


def guidance(profile: dict, context: dict, counts: dict, alerts: list[dict], most: int = 8) -> dict:
    """When to consult the memory, and at most eight actions for a new conversation, each beginning once."""
    zones = profile.get("danger_zones", [])
    triggers = [
        ("critical", "an error or unexpected failure", "error_lookup", f"{counts.get('errors', 0)} past errors are on record"),
        ("critical", "an unfamiliar system or code area", "search", f"{counts.get('artifacts', 0)} artifacts are on record"),
        ("critical", "a name or term that is not known", "search", "it may have come up before"),
        ("critical", "a decision on architecture, technology or design", "decisions", f"{counts.get('decisions', 0)} past decisions are on record"),
        ("critical", "a reference to past work", "search", "the user expects continuity"),
        *([("critical", "a change to " + ", ".join(z["path_pattern"] for z in zones[:4]), "search", f"{sum(z['issue_count'] for z in zones)} issues are on record")] if zones else []),
        ("recommended", "a feature like an existing one", "search", "patterns are established"),
        ("recommended", "a user who reports that something fails", "error_lookup", "it may recur"),
        ("optional", "a task of several steps", "search", "there may be prior attempts"),
    ]
    actions = []
    total, own = counts.get("artifacts", 0), counts.get("project_artifacts", 0)
    if total > 100:
        actions.append(f"Searchable history: {total} artifacts" + (f", {own} of this project" if own else ""))
    if profile.get("name"):
        n = profile.get("sessions", 0)
        actions.append(f"Address the user as {profile['name']}" + (f"; {n} sessions of shared history" if n >= 10 else ""))
    cycle = profile.get("lifecycle")
    if cycle:
        actions.append(f"Established workflow: {cycle}; keep to it")
        for word, ask in (("plan", "Outline the approach before implementing"), ("test", "Ask for tests before work counts as complete"), ("commit", "Offer a commit after each unit of work")):
            if word in cycle.lower():
                actions.append(ask)
    actions += profile.get("tips", [])
    actions += [f"Caution: {a['message']}" for a in alerts if a.get("priority") == "high"][:2]
    if context.get("active_topics"):
        actions.append(f"Recent work: {context['active_topics'][0][:60]}")
    if zones:
        actions.append("Files that caused issues: " + ", ".join(z["path_pattern"] for z in zones[:2]))
    once = {a[:50].lower(): a for a in reversed(actions)}
    kept = [a for a in dict.fromkeys(actions) if once[a[:50].lower()] == a]
    return {"triggers": [dict(zip(("priority", "situation", "tool", "reason"), t, strict=True)) for t in triggers], "actions": kept[:most]}
