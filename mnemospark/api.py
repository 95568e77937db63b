"""The tools of a conversation memory over one set of tables.

A memory holds DataFrames: messages (session_id, msg_idx, role, content, ts), operations, vectors. Each tool returns small
results, collected at its end; all work before is Spark's.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions import gates as G
from mnemospark.functions import patterns as P
from mnemospark.operators import context, extract, fuzzy, history, profile, search, sessions, stats
from mnemospark.operators import vectors as V
from mnemospark.operators.staging import materialise
from mnemospark.sources import transcripts

SEARCH_HINTS = ["Try other or broader terms", "Look at the recent sessions for what there is", "Typos are corrected by the vocabulary"]
ERROR_HINTS = ["Try the type of the error alone", "Search all messages instead"]
DECISION_HINTS = ["State decisions as 'Decision: ...'", "Leave out the category", "Lower min_confidence for implicit decisions"]


@dataclass
class Memory:
    messages: DataFrame
    operations: DataFrame | None = None
    vectors: DataFrame | None = None  # session_id, chunk, embedding
    projects: DataFrame | None = None  # session_id, project_path
    archives: DataFrame | None = None  # session_id, text, updated_at
    as_of: Column = field(default_factory=F.current_timestamp)

    @classmethod
    def from_transcripts(cls, spark: SparkSession, root: str, **more) -> Memory:
        lines = transcripts.raw_lines(spark, root)
        said = transcripts.sessions(lines).select("session_id", C.decode_project(F.col("project")).alias("project_path"))
        ops = transcripts.file_operations(lines)  # event_id names an operation and keeps the order of its session's
        ops = ops.withColumn("event_id", F.concat_ws(":", "session_id", F.lpad(F.col("seq").cast("string"), 9, "0")))
        return cls(transcripts.messages(lines), ops, projects=said, **more)

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions with their metadata, times and project, written once."""
        times = self.messages.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_modified"))
        out = sessions.metadata(self.messages).join(times, "session_id")
        out = out.withColumn("project_path", F.lit(None).cast("string")) if self.projects is None else out.join(self.projects, "session_id", "left")
        return materialise(out, "sessions")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """The words of all messages, written once."""
        return materialise(fuzzy.vocabulary(self.messages, F.col("content"), "messages"), "vocabulary")

    def _scope(self, rows: DataFrame, project_path: str | None) -> DataFrame:
        if project_path is None or self.projects is None:
            return rows
        return rows.join(context.of_project(self.projects, project_path).select("session_id"), "session_id", "left_semi")

    def _corrected(self, query: str) -> tuple[str, dict[str, str], list[str]]:
        """The query with typos corrected by the vocabulary, the corrections, and the terms that stay unknown to it."""
        asked = self.messages.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(_words(query))], "term string")
        fixed = {r.term: r.correction for r in fuzzy.closest(asked, self.vocabulary).collect()}
        unknown = [r.term for r in asked.where(F.length("term") >= 3).join(self.vocabulary.select("term"), "term", "left_anti").orderBy("term").collect()]
        new = " ".join(fixed.get(w.lower(), w) for w in query.split()) if fixed else query
        return new, fixed, unknown

    # --- search ------------------------------------------------------------------------------------------------------
    def search(self, query: str, limit: int = 10, project_path: str | None = None, days: int | None = None, recency_bias: bool = True, compact: bool = True, query_vector: list[float] | None = None) -> dict:
        """Sessions that match a query, by the first tier that finds any, in the project, then in all.

        Tiers: vectors and keywords of the sessions' metadata together; then, added to what was found, texts that hold the
        query as it stands; if nothing was found, keywords of the messages, all of them, then any of them by number of
        excerpts. The answer names the tier, corrections, unknown terms, and hints if there is nothing.
        """
        if not query.strip() and query_vector is None:
            return {"results": [], "total": 0, "message": "No query provided"}
        query, fixed, unknown = self._corrected(query) if query.strip() else ("", {}, [])
        terms = search.parse(query)[0]
        found, tier = self._tiers(query, terms, limit, project_path, query_vector)
        known = found.join(self.sessions.select("session_id", "summary", "task_description", "keywords", "message_count", "started_at", "project_path"), "session_id", "left")
        if days:
            known = search.recent(known, "started_at", self.as_of, days)
        known = search.with_decay(known, "score", "started_at", self.as_of)
        order = [F.desc("decayed_score"), "session_id"] if recency_bias else ["rank_group", F.desc("score"), "session_id"]
        best = search.with_excerpts(known.orderBy(*order).limit(limit).drop("excerpts"), self.messages, terms or ["\0"])
        best = best.join(found.select("session_id", F.col("excerpts").alias("archive_excerpts")), "session_id", "left").orderBy(*order)
        out: dict = {"query": query, "search_type": tier, "corrections": fixed, "unknown_terms": unknown}
        if compact:
            shown = [r.asDict() for r in self._compact(best, terms, recency_bias).collect()]
            out["results"] = [{k: v for k, v in r.items() if v is not None} for r in shown]
        else:
            out["results"] = [r.asDict(recursive=True) for r in best.collect()]
            out["artifacts"] = self.artifacts(query, 5) if terms else []
        out["total"] = len(out["results"])
        if not out["total"]:
            n = self.sessions.count()
            out |= {"message": f"No results found for '{query}'. Searched {n} sessions." if n else "No conversations yet.", "suggestions": SEARCH_HINTS}
        return out

    def _tiers(self, query: str, terms: list[str], limit: int, project: str | None, vector: list[float] | None) -> tuple[DataFrame, str]:
        shape = ["session_id", "score", "search_source", "excerpts", "rank_group"]
        plain = lambda df: df.withColumn("excerpts", F.lit(None).cast("array<string>")).withColumn("rank_group", F.lit(1)).select(shape)
        scopes = list(dict.fromkeys((project, None)))
        tier, out = "none", None
        for scope in scopes:
            label = "_global" if scope is None and project is not None else ""
            keyword = search.keyword_top(self._scope(self.sessions, scope), "session_id", ["summary", "task_description", "keywords", "key_facts"], query, limit)
            if vector is not None and self.vectors is not None:
                q = F.array(*[F.lit(float(x)) for x in vector])
                near = search.vector_top(self._scope(self.vectors, scope), q, "session_id", "chunk", "embedding", limit).select("session_id", "score")
                hybrid = plain(search.merge_hybrid(near, keyword, limit=limit))
            else:
                hybrid = plain(keyword.withColumn("search_source", F.lit("keyword")))
            hybrid = materialise(hybrid, "tier")
            if not hybrid.isEmpty():
                tier, out = f"hybrid{label}", hybrid
                break
        for scope in scopes:
            if self.archives is None or not query:
                break
            hits = materialise(search.substring_matches(self._scope(self.archives, scope), "session_id", "text", query, "updated_at", limit).select("session_id", "score", "excerpts"), "tier")
            if not hits.isEmpty():
                label = "archive" + ("_global" if scope is None and project is not None else "")
                if out is None:
                    tier, out = label, hits.select("session_id", "score", F.lit(label).alias("search_source"), "excerpts", F.lit(0).alias("rank_group"))
                else:
                    merged = search.merge_archive(out.select("session_id", "score", "excerpts"), hits).join(out.select("session_id", "search_source"), "session_id", "left")
                    tier, out = "combined", merged.withColumn("search_source", F.coalesce("search_source", F.lit(label))).select(shape)
                break
        for scope in scopes:
            if out is not None or not terms:
                break
            own = self._scope(self.messages, scope)
            every = materialise(plain(search.keyword_top(own, "session_id", ["content"], query, limit).withColumn("search_source", F.lit("messages"))), "tier")
            if not every.isEmpty():
                tier, out = "messages", every
        if out is None:
            some = search.fulltext(self.messages, terms or ["\0"], limit).drop("n_excerpts")
            tier, out = "fulltext", plain(some.withColumn("search_source", F.lit("fulltext")))
        return out, tier

    def _compact(self, best: DataFrame, terms: list[str], recency_bias: bool) -> DataFrame:
        """Short rows: id, summary, date, topics, excerpt, messages; score from 0.5 on, raw_score where the decay is below 0.7."""
        score = F.col("decayed_score") if recency_bias else F.col("score")
        point = lambda e: F.when(e["role"] == "assistant", 2.0).otherwise(0.0) + F.size(e["matched_terms"]) + F.least(F.length(e["excerpt"]) / 150.0, F.lit(2.0))
        own = F.array_max(F.transform("excerpts", lambda e, i: F.struct(F.round(point(e), 6).alias("p"), (-i).alias("i"), e["excerpt"].alias("x"))))["x"]
        date = F.coalesce(F.date_format("started_at", "yyyy-MM-dd"), F.lit(""))
        return best.select(
            F.substring(F.col("session_id").cast("string"), 1, 8).alias("id"), C.short_summary(F.col("summary"), F.col("task_description")).alias("summary"), date.alias("date"),
            C.topics(F.coalesce("keywords", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in terms]).cast("array<string>")).alias("topics"),
            F.coalesce(F.try_element_at("archive_excerpts", F.lit(1)), own, F.lit("")).alias("excerpt"), F.coalesce("message_count", F.lit(0)).alias("messages"),
            F.when(score > 0.5, F.round(score, 2)).alias("score"), F.when((score > 0.5) & (F.col("decay_factor") < 0.7), F.round("score", 2)).alias("raw_score"),
        )

    def artifacts(self, query: str, limit: int = 5, most: int = 500) -> list[dict]:
        """Artifacts that hold any of the first five terms of a query, best first."""
        terms = search.parse(query)[0][:5]
        found = extract.artifacts(self.messages)
        if not terms:
            return []
        key = F.concat_ws(":", F.col("session_id").cast("string"), "hash")
        found = found.withColumn("key", key)
        top = search.bm25(found, "key", F.concat_ws(" ", "content", "language"), terms).orderBy(F.desc("score"), "key").limit(limit)
        shown = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
        rows = top.join(found, "key").orderBy(F.desc("score"), "key").select("session_id", "artifact_type", "language", shown.alias("excerpt"), "score")
        return [r.asDict() for r in rows.collect()]

    # --- other tools -------------------------------------------------------------------------------------------------
    def recent(self, limit: int = 10, days: int | None = None, project_path: str | None = None) -> dict:
        found = self._scope(self.sessions, project_path)
        if days is not None:
            found = found.where(F.col("started_at") >= self.as_of - F.make_dt_interval(F.lit(days)))
        rows = sessions.group_by_project(sessions.recent(found, limit)).orderBy(F.desc_nulls_last("latest")).collect()
        return {"projects": [{"path": r.project_path, "sessions": [s.asDict() for s in r.sessions]} for r in rows], "total": sum(r.n_sessions for r in rows)}

    def error_lookup(self, query: str, limit: int = 5, project_path: str | None = None) -> dict:
        """Known errors with their solutions; of the project first, then of all."""
        if not query.strip():
            return {"solutions": [], "total": 0}
        query, fixed, _ = self._corrected(query)
        rows, source = [], "local"
        for scope in dict.fromkeys((project_path, None)):
            m = self._scope(self.messages, scope)
            found = extract.error_patterns(extract.with_solutions(extract.errors(m), m))
            ranked = search.bm25(found, "signature", F.concat_ws(" ", "error_type", "normalised_message", "solution_summary"), search.parse(query)[0]).join(found, "signature")
            rows = [r.asDict() for r in ranked.orderBy(F.desc("score"), F.desc("occurrence_count"), "signature").limit(limit).collect()]
            if rows:
                source = "project" if scope else "all"
                break
        out = {"solutions": rows, "total": len(rows), "query": query, "source": source, "corrections": fixed}
        return out if rows else out | {"message": f"No past errors found matching '{query}'.", "suggestions": ERROR_HINTS}

    def decisions(self, query: str | None = None, category: str | None = None, limit: int = 10, project_path: str | None = None, min_confidence: float = 0.0) -> dict:
        """Decisions that match a query, or the surest and latest ones; of the project first, then of all."""
        fixed: dict[str, str] = {}
        if query:
            query, fixed, _ = self._corrected(query)
        rows: list[dict] = []
        for scope in dict.fromkeys((project_path, None)):
            m = self._scope(self.messages, scope)
            found = extract.decisions(m).join(m.select("session_id", "msg_idx", "ts"), ["session_id", "msg_idx"]).where(F.col("confidence") >= min_confidence)
            if category:
                found = found.where(F.col("category") == category)
            found = extract.first_of(found, ["hash"], ["session_id", "msg_idx"])
            if query and search.parse(query)[0]:
                ordered = search.bm25(found, "hash", F.col("decision"), search.parse(query)[0]).join(found, "hash").orderBy(F.desc("score"), "hash")
            else:
                ordered = found.orderBy(F.desc("confidence"), F.desc("ts"), "hash")
            rows = [r.asDict() for r in ordered.limit(limit).collect()]
            if rows:
                break
        out = {"decisions": rows, "total": len(rows), "query": query, "category": category, "min_confidence": min_confidence, "corrections": fixed}
        return out if rows else out | {"message": "No past decisions found.", "suggestions": DECISION_HINTS}

    def code_history(self, path: str | None = None, symbol: str | None = None, mode: str = "timeline", date: str | None = None, limit: int = 20) -> dict:
        """timeline of a file or symbol, snapshot of a file as of a date, or its changes of the year up to then."""
        if self.operations is None or not (path or symbol):
            return {"error": "a path or a symbol is needed", "mode": mode}
        if mode not in ("timeline", "snapshot", "changes"):
            return {"error": f"unknown mode {mode}", "mode": mode}
        ops = self.operations if path is None else self.operations.where(F.ilike("file_path", F.lit(C.like_pattern(path))))
        until = F.lit(f"{date} 23:59:59.999" if date and len(date) == 10 else date).cast("timestamp") if date else self.as_of
        if date:
            ops = ops.where(F.col("ts") <= until)
        if mode == "snapshot":
            rows = history.reconstruct(ops).limit(limit)
        elif mode == "changes":
            rows = history.shown_changes(ops.where(F.col("ts") > until - F.expr("interval 365 days")), limit)
        elif symbol:
            rows = history.symbol_history(ops, symbol, limit)
        else:
            rows = history.timeline(ops, limit=limit)
        return {"mode": mode, "results": [r.asDict() for r in rows.collect()]}

    def status(self) -> dict:
        buckets = stats.size_buckets(self.messages)
        index = V.figures(self.sessions, self.vectors).first().asDict() if self.vectors is not None else None
        m = self.messages
        errors = extract.error_patterns(extract.with_solutions(extract.errors(m), m))
        return {
            "progress": stats.progress(buckets, F.lit(index["indexed"] if index else 0)).first().asDict(), "buckets": {r.bucket: r.n_sessions for r in buckets.collect()}, "index": index,
            "artifacts": {r.artifact_type: r.n for r in stats.counts(extract.artifacts(m), "artifact_type").collect()},
            "decisions": stats.decision_stats(extract.decisions(m)).first().asDict(), "errors": stats.error_stats(errors).first().asDict(),
            "journey": history.journey(self.operations).first().asDict() if self.operations is not None else None,
        }

    def profile(self, project_path: str | None = None) -> dict:
        """The user: name, preferences, rules that hold, files to be careful with, ways of working."""
        m = self._scope(self.messages, project_path)
        times = m.select("session_id", "msg_idx", "ts")
        names = profile.name_scores(profile.name_candidates(m)).orderBy(F.desc("score"), "name").limit(1).collect()
        prefs = profile.preferences(m).where((F.col("confidence") >= 0.5) & ~profile.is_approval(F.col("preference"))).orderBy("category", F.desc("frequency"), "preference").limit(50).collect()
        rules = profile.learned_rules(profile.rules(m), profile.revocations(m)).where("not revoked")
        seen = times.select(F.col("session_id").alias("s"), F.col("msg_idx").alias("i"), F.col("ts").alias("seen_at"))
        rules = rules.join(seen, (F.col("last_seen.session_id") == F.col("s")) & (F.col("last_seen.msg_idx") == F.col("i"))).withColumn("last_seen", F.col("seen_at"))
        top = profile.decayed_rules(rules, self.as_of, 30).withColumn("place", F.struct(-F.col("frequency"), -F.col("effective"), "rule_text"))
        by_kind: dict[str, list[str]] = {}
        for r in top.select("rule_type", G.shown_rule(F.col("rule_text"), 45).alias("shown")).collect():
            by_kind.setdefault(r.rule_type, []).append(r.shown)
        tips = [r.tip for r in context.rule_tips(top).orderBy("rank").collect()]
        talk = [r.tip for r in self.messages.sparkSession.createDataFrame([(p.preference,) for p in prefs if p.category == "communication"], "p string").select(context.preference_tip(F.col("p")).alias("tip")).where("tip is not null").collect()]
        per = profile.session_patterns(m)
        work = profile.work_patterns(per)
        latest = per.join(times.groupBy("session_id").agg(F.max("ts").alias("t")), "session_id").groupBy("pattern_type", "description").agg(F.max("t").alias("seen"))
        cycle = profile.best_lifecycle(work.join(latest, ["pattern_type", "description"]), "seen", self.as_of).collect()
        habits = work.where("pattern_type = 'workflow' and frequency >= 2").orderBy(F.desc("frequency"), "description").limit(10).collect()
        zones = extract.shown_zones(extract.danger_zones(m, 2)).orderBy(F.desc("issue_count"), "path_pattern").limit(10).collect()
        out = {
            "name": names[0].name if names else None, "sessions": m.select("session_id").distinct().count(), "preferences": [p.asDict() for p in prefs], "rules": by_kind, "danger_zones": [z.asDict() for z in zones],
            "lifecycle": cycle[0].description if cycle else None, "work_patterns": [h.description for h in habits], "tips": (talk + tips)[:10],
        }
        return out | {"summary": context.profile_summary(out)}

    def init(self, project_path: str | None = None, environments: list[str] | None = None) -> dict:
        """What a new conversation should know: profile, current work, last session, decisions, knowledge, alerts, guidance."""
        m = self._scope(self.messages, project_path)
        who = self.profile(project_path)
        own = context.of_project(self.sessions, project_path) if project_path and self.projects is not None else self.sessions
        some = context.newest(own, 50 if project_path else 15).withColumn("all", F.lit(1))
        tasks = context.recent_tasks(some, "all")
        topics = [r.topic for r in context.active_topics(some, "all", tasks).orderBy("rank").collect()]
        facts = some.select("all", "place", F.posexplode("key_facts").alias("at", "fact"))
        work = {
            "recent_tasks": [r.shown for r in context.shown_tasks(tasks).orderBy("rank").collect()], "active_topics": topics,
            "recent_decisions": [r.fact for r in context.recent_decisions(facts, "all").orderBy("rank").collect()],
        }
        last = [r.asDict() for r in context.last_session(own).collect()]
        decided = extract.first_of(extract.decisions(m).join(m.select("session_id", "msg_idx", "ts"), ["session_id", "msg_idx"]), ["hash"], ["session_id", "msg_idx"])
        structured = [r.asDict() for r in context.structured_decisions(decided.withColumn("reasoning", F.lit(None).cast("string"))).collect()]
        known = extract.concepts(m, F.lit(project_path or "")).where("confidence >= 0.3")
        concepts = [r.asDict(recursive=True) for r in extract.knowledge(known).drop("project_path").collect()]
        alerts = []
        if environments:
            ready = profile.prerequisite_alerts(profile.prerequisites(profile.statements(m)), environments)
            alerts = [r.asDict() for r in ready.orderBy(F.desc("confidence"), F.desc("frequency"), "message").limit(20).collect()]
        if self.operations is not None and who["danger_zones"]:
            zones = extract.danger_zones(m, 2)
            touched = profile.zone_alerts(zones, history.recent_files(self._scope(self.operations, project_path))).orderBy("path_pattern").limit(10).collect()
            alerts += [{"type": "danger_zone", "priority": "medium", "message": f"Recent changes to danger zone: {z.path_pattern}"} for z in touched]
        if who["rules"].get("never"):
            alerts.append({"type": "reminder", "priority": "low", "message": f"User rule: never {who['rules']['never'][0]}"})
        everything = stats.counts(extract.artifacts(self.messages), "artifact_type").collect()
        ours = stats.counts(extract.artifacts(m), "artifact_type").collect() if project_path else []
        counts = {
            "artifacts": sum(r.n for r in everything), "errors": sum(r.n for r in everything if r.artifact_type == "error"), "project_artifacts": sum(r.n for r in ours),
            "decisions": extract.decisions(self.messages).count(),
        }
        out = {
            "profile": who, "current_work": {k: v for k, v in work.items() if v}, "last_session": last[0] if last else None, "recent_decisions": structured,
            "knowledge": {k: v for k, v in (concepts[0] if concepts else {}).items() if v and k in ("integrations", "patterns", "facts", "rules")}, "technologies": [c["name"] for c in (concepts[0]["technologies"] if concepts else [])],
            "alerts": alerts, "guidance": context.guidance(who, work, counts, alerts),
        }
        size = len(json.dumps(out, default=str, separators=(",", ":")))
        return out | {"token_estimate": {"chars": size, "tokens": size // 4}}


def report(init: dict) -> str:
    """What ``Memory.init`` returns as text, a section a line or list."""
    out = [init["profile"]["summary"]]
    for title, lines in (
        ("Recent tasks", init["current_work"].get("recent_tasks", [])), ("Topics", init["current_work"].get("active_topics", [])), ("Decisions", [d["decision"] for d in init["recent_decisions"]]),
        ("Alerts", [f"[{a['priority']}] {a['message']}" for a in init["alerts"]]), ("To do", init["guidance"]["actions"]),
    ):
        if lines:
            out.append(f"{title}:\n" + "\n".join(f"- {x}" for x in lines))
    if init.get("last_session"):
        out.append(f"Last session: {init['last_session']['summary']}")
    return "\n\n".join(out)


def _words(text: str) -> list[str]:
    return [w for w in search.parse(text)[0] if w not in P.FUZZY_STOPWORDS]
