"""Conditions on texts: which rules, prerequisites, topics, decisions and tasks are worth keeping, and how they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P


# --- rules ----------------------------------------------------------------------------------------------------------
def rule_words(text: Column) -> Column:
    """The words of a rule that count in comparisons, in order: lower case, no punctuation, fillers or single letters."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: ~w.isin(P.RULE_FILLERS) & (F.length(w) > 1))


def normalised_rule(text: Column) -> Column:
    return F.array_join(rule_words(text), " ")


def states_no_rule(message: Column, rule: Column) -> Column:
    """Whether what looks like a rule is none: questions, quotations, suppositions, code, lists, fragments."""
    said, lower, rule_lower = F.lower(message), C.strip(rule), F.lower(rule)
    return (
        ~F.length(lower).between(5, 150) | F.endswith(C.strip(message), F.lit("?")) | C.any_of(said, P.NO_RULE_MESSAGES) | (C.count_of(message, "```") >= 4)
        | C.any_of(rule_lower, P.RULE_FILTER_WORDS) | C.any_of(rule, P.NO_RULE_SIGNS) | F.regexp_like(lower, F.lit(r"^[-*]")) | F.regexp_like(rule, F.lit(r"^\d[.):]"))
        | (C.letter_share(rule) < 0.75) | C.any_of(rule_lower, P.NO_RULE_PHRASES)
    )


def scope(message: Column) -> Column:
    """What a message's rules are about; null if it does not say."""
    found = [F.regexp_extract(F.lower(message), p, 1) for p in P.SCOPE_PATTERNS]
    return F.coalesce(*[F.when((C.strip(f) != "") & ~C.strip(f).isin(P.NO_SCOPES), C.strip(f)) for f in found])


def shown_rule(rule: Column, most: int = 60) -> Column:
    """A rule in at most ``most`` characters, cut at a word."""
    rule = C.strip(rule)
    cut = F.substring(rule, 1, most)
    word = F.regexp_extract(cut, r"^([\s\S]*) [^ ]*$", 1)
    kept = F.when(F.length(word) > most * 0.6, word).otherwise(cut)
    return F.when(F.length(rule) <= most, rule).otherwise(F.concat(F.regexp_replace(kept, r"[.,;:]+$", ""), F.lit("...")))


# --- prerequisites --------------------------------------------------------------------------------------------------
def is_prerequisite(environment: Column, action: Column) -> Column:
    """Whether an environment and an action make sense together."""
    env, act = F.lower(C.strip(environment)), F.lower(C.strip(action))
    known = C.any_of(env, P.ENVIRONMENTS) | (F.length(env) <= 15)
    broken = (F.contains(env, F.lit(" ")) & (F.length(env) > 20)) | C.any_of(env, ["(", ")", "{", "}", "=", ":"])
    return (known | ~broken) & ~C.any_of(act, P.NO_ACTIONS) & (C.letter_share(action) >= 0.7) & (C.any_of(act, P.ACTION_WORDS) | C.starts_with_any(act, P.ACTION_STARTS))


# --- tasks, topics, decisions ----------------------------------------------------------------------------------------
def task_key(task: Column) -> Column:
    """A task as it is compared: without prefix, squeezed, its first 100 characters in lower case."""
    plain = F.regexp_replace(C.strip(task), "^(?:Task: |task: |TODO: |todo: )", "")
    return F.lower(F.substring(C.squeeze(plain), 1, 100))


def topic_words(text: Column) -> Column:
    """The distinct words of a topic that say something."""
    words = F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[.,!?:;()\[\]{}\"'-]+|[.,!?:;()\[\]{}\"'-]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(P.TOPIC_STOPWORDS)))


def same_task(a: Column, b: Column) -> Column:
    """Whether two tasks are one: the beginning of one begins the other, or more than 60 % of the smaller one's words are shared."""
    ka, kb, wa, wb = task_key(a), task_key(b), topic_words(a), topic_words(b)
    smaller = F.least(F.size(wa), F.size(wb))
    shared = F.when(smaller > 0, F.size(F.array_intersect(wa, wb)) / smaller > 0.6).otherwise(False)
    return F.startswith(ka, F.substring(kb, 1, 40)) | F.startswith(kb, F.substring(ka, 1, 40)) | shared


def is_completed(topic: Column, known: list[str] | None = None) -> Column:
    """Whether a topic is over, by its words or its status. ``known``: topics that a project has behind it."""
    t = F.lower(topic)
    status = F.contains(t, F.lit('"status":')) & ~F.contains(t, F.lit('"pending"')) & ~F.contains(t, F.lit('"in_progress"'))
    return C.any_of(t, P.COMPLETED) | F.contains(t, F.lit("status: completed")) | status | C.any_of(t, known or [])


def is_active(topic: Column, known: list[str] | None = None) -> Column:
    return (F.length(C.strip(topic)) >= 10) & ~is_completed(topic, known)


def is_decision(fact: Column) -> Column:
    """Whether a fact is a whole, meaningful sentence."""
    words = F.filter(F.split(fact, r"(?U)\s+"), lambda w: w != "")
    return (
        (F.length(C.strip(fact)) >= 15) & ~C.any_of(F.lower(fact), P.NO_DECISIONS) & F.regexp_like(fact, F.lit(r"^\p{Lu}")) & F.regexp_like(fact, F.lit(r"[.!?]\s*$"))
        & (F.size(words) >= 4) & (C.letter_share(fact) >= 0.75)
    )


def is_sound_summary(summary: Column) -> Column:
    """Whether a decision's summary is no fragment, directive or description of a problem."""
    s = F.lower(summary)
    return (
        (F.length(summary) >= 15) & ~C.any_of(s, P.NO_SUMMARIES) & F.regexp_like(summary, F.lit(r"^\p{Lu}")) & ~C.starts_with_any(s, P.DIRECTIVES) & ~C.any_of(s, P.PROBLEMS)
        & ~F.contains(F.substring(summary, 1, 20), F.lit(" - ")) & (C.count_of(summary, "[") == C.count_of(summary, "]")) & (C.count_of(summary, "(") == C.count_of(summary, ")"))
        & ~F.regexp_like(summary, F.lit(r"[\[(\-:,]\s*$")) & (C.letter_share(summary) >= 0.8)
    )


def is_task(task: Column) -> Column:
    """Whether a task is real work: no question about the past, no command, not too short."""
    return (F.length(task) >= 10) & ~C.any_of(F.lower(task), P.META_TASKS) & ~F.startswith(task, F.lit("/"))


def shown_task(task: Column) -> Column:
    return F.when(F.length(task) > 100, F.concat(F.substring(task, 1, 97), F.lit("..."))).otherwise(task)


def plain_summary(summary: Column) -> Column:
    """A summary without its task: the part behind the last bar, or what follows the label."""
    after = C.strip(F.element_at(F.split(summary, r"\|"), -1))
    return F.when(F.startswith(summary, F.lit("Task:")), F.when(F.contains(summary, F.lit("|")), after).otherwise(C.strip(F.substring(summary, 6, 1 << 30)))).otherwise(summary)


def is_real_session(summary: Column, task: Column) -> Column:
    """Whether a session did work that is worth going on with."""
    plain, task = plain_summary(summary), F.coalesce(task, F.lit(""))
    return (
        (F.length(summary) >= 20) & ~C.any_of(F.lower(summary), P.META_QUESTIONS) & ~C.any_of(F.lower(task), P.META_QUESTIONS) & ~F.endswith(C.strip(task), F.lit("?"))
        & (F.length(plain) >= 30) & F.regexp_like(plain, F.lit(r"^\p{L}"))
    )


def shown_bytes(size: Column) -> Column:
    """A size with one decimal in the largest unit of B, KB, MB, GB, TB that leaves it below 1024."""
    out = F.format_string("%.1f TB", F.bround(size / float(1 << 40), 1))
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(size < 1024 << 10 * i, F.format_string(f"%.1f {unit}", F.bround(size / float(1 << 10 * i), 1))).otherwise(out)
    return out
