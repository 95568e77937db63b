"""Scalar functions over columns: texts, hashes, times and scores. All stay in the JVM."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import patterns as P

#: Characters that Unicode calls white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Words in any script, with hyphens inside.
WORDS = r"[\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*"


# --- texts ----------------------------------------------------------------------------------------------------------
def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, as it stands."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def starts_with_any(text: Column, beginnings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(w)) for w in beginnings], F.lit(False))


def letter_share(text: Column) -> Column:
    """Share of letters and white space."""
    return F.length(F.regexp_replace(text, r"(?U)[^\p{L}\s]", "")) / F.greatest(F.lit(1), F.length(text))


def count_of(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def query_terms(query: Column, most: int = 10) -> Column:
    """The first lower-cased words of three or more ASCII letters and digits; repeats stay."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[a-z0-9]{3,}$"))), 1, most)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits that are no stopwords."""
    return F.filter(tokens(text), lambda w: ~w.isin(P.SEARCH_STOPWORDS))


def vocabulary_terms(text: Column) -> Column:
    """Distinct lower-cased ASCII words of four or more characters that are no stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return F.filter(F.array_distinct(found), lambda t: F.regexp_like(t, F.lit("^[a-z][a-z0-9_-]*$")) & (F.length(t) >= P.FUZZY_LEAST_LENGTH) & ~t.isin(P.FUZZY_STOPWORDS))


def excerpt_around(text: Column, terms: Column, context: int = 200) -> Column:
    """The text around the earliest term, cut at spaces and marked where cut; without a term, its beginning.

    Of terms that begin at one place, the first counts.
    """
    lower = F.lower(text)
    hits = F.filter(F.transform(terms, lambda t, i: F.struct(F.position(t, lower).alias("at"), i.alias("i"), F.length(t).alias("n"))), lambda h: h["at"] > 0)
    first = F.array_min(hits)
    at, size, n = first["at"] - 1, F.length(text), first["n"]
    begin = F.greatest(F.lit(0), at - context)
    word = begin - F.length(F.regexp_extract(F.substring(text, F.lit(1), begin), r"[\p{L}\p{N}]*$", 0))
    space = F.position(F.lit(" "), F.substring(text, word + 1, at - word))
    start = F.when(begin > 0, F.when(space > 0, word + space).otherwise(word)).otherwise(0)
    end = F.least(size, at + n + context)
    back = F.position(F.lit(" "), F.reverse(F.substring(text, at + 1, end - at)))
    stop = F.when((end < size) & (back > 0), end - back).otherwise(end)
    around = F.concat(F.when(start > 0, "...").otherwise(""), strip(F.substring(text, start + 1, stop - start)), F.when(stop < size, "...").otherwise(""))
    beginning = F.concat(F.substring(text, 1, 2 * context), F.when(size > 2 * context, "...").otherwise(""))
    return F.when(F.size(hits) == 0, beginning).otherwise(around)


def excerpts_of(text: Column, query: str, most: int = 3, context: int = 100) -> Column:
    """The text around each of the first places where the query stands, whatever the case; places do not overlap."""
    if not query:
        return F.array().cast("array<string>")
    parts = F.split(F.lower(text), "\\Q" + query.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E")
    size, n = F.length(text), len(query)

    def one(i: Column) -> Column:
        at = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * n
        begin, end = F.greatest(F.lit(0), at - context), F.least(size, at + n + context)
        back = F.position(F.lit(" "), F.reverse(F.substring(text, begin + 1, at - begin)))
        start = F.when((begin > 0) & (back > 0) & (at - back > begin), at - back + 1).otherwise(begin)
        return F.concat(F.when(start > 0, "...").otherwise(""), strip(F.substring(text, start + 1, end - start)), F.when(end < size, "...").otherwise(""))

    found = F.least(F.size(parts) - 1, F.lit(most))
    return F.when(found > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), found)), one)).otherwise(F.array().cast("array<string>"))


def topics(keywords: Column, terms: Column, most: int = 5) -> Column:
    """Keywords that say something, those of the query first."""
    kept = F.filter(keywords, lambda k: ~F.lower(k).isin(P.SEARCH_STOPWORDS) & (F.length(k) > 2))
    asked = lambda k: F.array_contains(F.transform(terms, F.lower), F.lower(k))
    return F.slice(F.concat(F.filter(kept, asked), F.filter(kept, lambda k: ~asked(k))), 1, most)


def short_summary(summary: Column, task: Column, most: int = 100) -> Column:
    """The outcome that a summary names, else the shorter of summary and task, cut with dots."""
    cut = lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))
    summary, task = F.coalesce(summary, F.lit("")), F.coalesce(task, F.lit(""))
    outcome = F.split_part(summary, F.lit(" | Outcome: "), F.lit(2))
    shorter = F.when((task != "") & ((summary == "") | (F.length(task) < F.length(summary))), task).otherwise(summary)
    return F.when(F.contains(summary, F.lit(" | Outcome: ")), cut(outcome)).otherwise(cut(shorter))


def truncate_words(text: Column, most: int, least: int) -> Column:
    """Cut after ``most`` characters, at the last space if it lies beyond ``least``, and mark the cut."""
    cut = F.substring(text, 1, most)
    at_space = F.regexp_extract(cut, r"^([\s\S]*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(at_space) > least, at_space).otherwise(cut), F.lit("...")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: expressions that nest otherwise multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_task(text: Column) -> Column:
    """A task description: greetings and polite prefixes removed, first letter raised, at most about 200 characters."""
    out = strip(text)
    for pattern in P.TASK_GREETINGS:
        out = strip(F.regexp_replace(out, pattern, ""))
    greeting = r"(?i)^(?:hi|hello|hey|thanks?|good\s+(?:morning|afternoon|evening))"

    def main(whole: Column) -> Column:
        real = lambda sentences: F.filter(F.transform(sentences, strip), lambda s: (F.length(s) >= 15) & ~F.regexp_like(s, F.lit(greeting)))
        return let(F.split(whole, r"(?<=[.!?])\s+"), lambda all_: F.coalesce(F.when(F.size(all_) > 1, F.get(real(all_), F.lit(0))), whole))

    out = F.regexp_replace(let(out, main), "(?i)^(?:" + "|".join(P.TASK_PREFIXES) + ")+", "")
    out = let(out, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))
    return F.coalesce(strip(let(out, lambda t: truncate_words(t, 200, 100))), F.lit(""))


def normalise_error(message: Column) -> Column:
    for pattern, to in P.ERROR_REWRITES:
        message = F.regexp_replace(message, pattern, to)
    return strip(message)


def error_type(message: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(message, f"(?im){p}", 1), F.lit("")) for p in P.ERROR_TYPES])


def error_signature(kind: Column, normalised: Column) -> Column:
    """Of the type and the text; of the text alone if there is no type."""
    return F.substring(F.sha2(F.concat(F.coalesce(F.concat(kind, F.lit(":")), F.lit("")), F.substring(normalised, 1, 200)), 256), 1, 16)


def decision_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.substring(F.lower(strip(text)), 1, 200), 256), 1, 16)


def decision_category(text: Column) -> Column:
    out = F.lit("general")
    for category, words in reversed(P.DECISION_CATEGORIES):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words]), category).otherwise(out)
    return out


def detect_language(code: Column) -> Column:
    """The programming language most of whose patterns are found; null if none is."""
    scores = [
        F.struct(reduce(lambda a, b: a + b, [F.regexp_like(code, F.lit(f"(?im){p}")).cast("int") for p in found]).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, found) in enumerate(P.LANGUAGES)
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"])


def bigrams(text: Column) -> Column:
    return F.array_distinct(F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    """The larger of the Jaccard similarities of words and of character pairs of squeezed, lower-cased texts; 0 for an empty one."""
    a, b = F.lower(squeeze(a)), F.lower(squeeze(b))
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    return F.when(a == b, F.when(a != "", 1.0).otherwise(0.0)).otherwise(F.greatest(jaccard(words(a), words(b)), jaccard(bigrams(a), bigrams(b))))


def decode_project(name: Column) -> Column:
    """A directory name of a project as its path; dashes of the path itself are lost."""
    return F.concat(F.lit("/"), F.ltrim(F.replace(name, F.lit("-"), F.lit("/")), F.lit("/")))


def normalise_remote(url: Column) -> Column:
    """host/owner/name of a git remote, as SSH or web address; letters keep their case."""
    url = F.regexp_replace(url, r"\.git$", "")
    plain = F.regexp_replace(url, "^(?:ssh://(?:git@)?|https://|http://)", "")
    return F.when(F.startswith(url, F.lit("git@")), F.regexp_replace(F.substring(url, 5, 1 << 30), "^([^:]*):", "$1/")).otherwise(plain)


def json_list(text: Column) -> Column:
    """A JSON list of texts; empty if it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def like_pattern(path: str) -> str:
    """A LIKE pattern of a path with * as wildcard; _, % and backslashes mean themselves. A bare name matches in any folder."""
    out = re.sub(r"([\\_%])", r"\\\1", path).replace("*", "%")
    return out if "/" in out or out.startswith("%") else f"%{out}"


# --- times and scores -----------------------------------------------------------------------------------------------
def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 86_400_000_000.0


def decay(ts: Column, as_of: Column, half_life: float = P.HALF_LIFE_DAYS) -> Column:
    """Exponential decay with a floor; 1 for the future, a neutral value without a time."""
    factor = F.greatest(F.lit(P.LEAST_DECAY), F.least(F.lit(1.0), F.exp(-math.log(2) / half_life * age_days(ts, as_of))))
    return F.when(ts.isNull(), P.NEUTRAL_DECAY).otherwise(factor)


def rule_decay(age: Column, confidence: Column, frequency: Column) -> Column:
    """Steps at 7, 30 and 90 days; a rule that is exactly so old is beyond the step."""
    step = F.when(age < 7, 1.0).when(age < 30, 0.85).when(age < 90, 0.70).otherwise(0.50)
    return F.round(F.least(F.lit(1.0), confidence * step * F.least(F.lit(1.2), 1 + 0.05 * (frequency - 1))), 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
