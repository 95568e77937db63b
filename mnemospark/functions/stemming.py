"""The published Snowball algorithm for English stems, as rules that Spark, Python and SQL apply alike.

A word is lower-cased ASCII letters and digits. A step is a list of rules, endings that contain another one first; the first
ending that a word has decides the step. A rule holds what must stand before its ending and what replaces it. A word that a
step is done with carries a mark until the step's end. No expression looks ahead or back, so that any engine runs them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's letters, endings and exceptions, and the stop words of the public English full-text list.
VOWEL, OTHER = "[aeiouy]", "[^aeiouy~]"
WHOLE_BEGINNINGS = ["gener", "commun", "arsen"]
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_LATER = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

_V, _C = VOWEL, OTHER
_BEGINNINGS = "|".join(WHOLE_BEGINNINGS)
_BEFORE_LI = "cdeghkmnrt"
_DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]

Rule = tuple[str, str, str]  # what stands before, the ending, its replacement


def _steps(opening: str, openings: dict[str, str], long_enough: str) -> list[list[Rule]]:
    """``opening``: a word up to its first region, ``openings``: the same where its last letter is one of some, ``long_enough``: up to an e that goes in the first region."""
    second = f"{opening}.*?{_V}"
    ends = lambda letters: f"(?:{opening}.*[{letters}]{openings[letters]})"
    ends_second = lambda letters: f"(?:{second}{_C}.*[{letters}]|{second}[{letters}])"
    r1, r2 = f"{opening}.*", f"{second}{_C}.*"
    vowel = f".*{_V}.*"
    return [
        [(".*", "sses", "ss"), (".{2,}", "ied", "i"), (".*", "ied", "ie"), (".{2,}", "ies", "i"), (".*", "ies", "ie"), (".*", "us", "us"), (".*", "ss", "ss"), (f".*{_V}.+", "s", "")],
        [(r1, "eedly", "ee"), (vowel, "ingly", "!"), (vowel, "edly", "!"), (r1, "eed", "ee"), (vowel, "ing", "!"), (vowel, "ed", "!")],
        [
            (".*", "at!", "ate"), (".*", "bl!", "ble"), (".*", "iz!", "ize"), *[(".*", f"{d}!", d[0]) for d in _DOUBLES],
            (f"(?:{_C}+{_V}[^aeiouywxY~]|{_V}{_C}|{_BEGINNINGS})", "!", "e"), (".*", "!", ""),
        ],
        [(f".+{_C}", "y", "i"), (f".+{_C}", "Y", "i")],
        [
            (r1, "ization", "ize"), (r1, "ational", "ate"), (r1, "fulness", "ful"), (r1, "ousness", "ous"), (r1, "iveness", "ive"), (r1, "tional", "tion"), (r1, "biliti", "ble"),
            (r1, "lessli", "less"), (r1, "entli", "ent"), (r1, "ation", "ate"), (r1, "alism", "al"), (r1, "aliti", "al"), (r1, "ousli", "ous"), (r1, "iviti", "ive"), (r1, "fulli", "ful"),
            (r1, "enci", "ence"), (r1, "anci", "ance"), (r1, "abli", "able"), (r1, "izer", "ize"), (r1, "ator", "ate"), (r1, "alli", "al"), (r1, "bli", "ble"),
            (ends("l"), "ogi", "og"), (ends(_BEFORE_LI), "li", ""),
        ],
        [(r1, "ational", "ate"), (r1, "tional", "tion"), (r1, "alize", "al"), (r1, "icate", "ic"), (r1, "iciti", "ic"), (r2, "ative", ""), (r1, "ical", "ic"), (r1, "ness", ""), (r1, "ful", "")],
        [
            *[(r2, e, "") for e in ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]],
            (ends_second("st"), "ion", ""), *[(r2, e, "") for e in ["al", "er", "ic"]],
        ],
        [(f"(?:{r2}|{long_enough})", "e", ""), (ends_second("l"), "l", "")],
    ]


_USUAL = _steps(f".*?{_V}{_C}", {"l": f"|.*?{_V}l", _BEFORE_LI: f"|.*?{_V}[cdghkmnrt]"}, f".*{_V}{_C}.*[aeiouywxY]|.*{_V}[wxY]|.*{_V}{_C}(?:.*{_C})?{_C}|.*{_V}{_V}{_C}")
_SPECIAL = _steps(f"(?:{_BEGINNINGS})", {"l": "", _BEFORE_LI: f"|{_BEGINNINGS}"}, f"(?:{_BEGINNINGS})(?:.*[aeiouywxY]|.*{_C}{_C}|{_C}|.*{_V}{_V}{_C})")


def _substitutions(steps: list[list[Rule]]) -> list[tuple[str, str]]:
    """Expressions and replacements one after another, groups written as in SQL."""
    out = []
    for n, step in enumerate(steps):
        for i, (before, ending, instead) in enumerate(step):
            out.append((f"^({before}){ending}$", rf"\1{instead}~"))
            later = [e for _, e, _ in step[i + 1 :]]
            if ending not in later and any(ending.endswith(e) for e in later):
                out.append((f"{ending}$", f"{ending}~"))
        out.append(("~$", ""))
        if n == 0:  # words that stay as they are from here on carry the mark to the end
            out.append((f"^({'|'.join(UNCHANGED_LATER)})$", r"\1="))
    return [*out, ("=$", ""), ("Y", "y")]


_MARK_Y = [("^y", "Y"), ("([aeiouy])y", r"\1Y")]


def _all(word, replace: Callable, usual: bool):
    for pattern, instead in [*_MARK_Y, *_substitutions(_USUAL if usual else _SPECIAL)]:
        word = replace(word, pattern, instead)
    return word


def stem_sql(word: str) -> str:
    """SQL for the stem of a lower-cased word."""
    replace = lambda w, p, r: f"regexp_replace({w}, '{p}', '{r}', 'g')"
    known = "".join(f" WHEN {word} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return f"CASE{known} WHEN length({word}) < 3 THEN {word} WHEN regexp_matches({word}, '^(?:{_BEGINNINGS})') THEN {_all(word, replace, False)} ELSE {_all(word, replace, True)} END"


def stem(word: str) -> str:
    """The stem of one lower-cased word, for the few words of a query."""
    if word in IRREGULAR or len(word) < 3:
        return IRREGULAR.get(word, word)
    return _all(word, lambda w, p, r: re.sub(p, r, w), re.match(_BEGINNINGS, word) is None)


def stem_column(word: Column) -> Column:
    """The stems of a column of lower-cased words; null stays null."""
    replace = lambda w, p, r: F.regexp_replace(w, p, r.replace("\\1", "$1"))
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])

    def one(w: Column) -> Column:
        special = F.regexp_like(w, F.lit(f"^(?:{_BEGINNINGS})"))
        return F.coalesce(F.element_at(known, w), F.when(F.length(w) < 3, w).when(special, _all(w, replace, False)).otherwise(_all(w, replace, True)))

    # inside an array's function, as generated code would be longer than a method may be
    return F.transform(F.array(word), one)[0]


def kept_beginning(stem: str) -> str:
    """What every word of a stem begins with: no rule changes more than the last two letters of what it leaves."""
    return stem[:-2]
