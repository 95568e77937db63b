"""The catalogue of registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from mnemospark.sources.samples import SENTENCES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: The derived views of sources.tables in DuckDB SQL.
EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
MESSAGES = EVENTS + r""",
  parts AS (SELECT count(*) AS parts FROM part),
  m AS (SELECT e.user_id AS session_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS msg_idx, event_id, event_type,
        CASE WHEN event_type IN ('error', 'click', 'signup') THEN 'user' ELSE 'assistant' END AS role, ts, k,
        CASE WHEN event_type = 'error' THEN 'TypeError: bad value ' || k || ' at /srv/app/m' || (user_id % 7) || '.py line ' || (event_id % 100)
             WHEN event_type = 'purchase' THEN 'Decision: use ' || p_name || ' for ' || p_type
             WHEN event_type = 'view' THEN 'The fix is: restart worker ' || (user_id % 5) || ' and clear the ' || k || ' cache'
             WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'See this' || chr(10) || '```python' || chr(10) || 'def f' || k || '(x):' || chr(10) || '    return x + ' || k || chr(10) || '```' || chr(10)
             WHEN event_type = 'click' THEN 'never commit straight into release' || (k % 10) || ' branches, issue in src/m' || (user_id % 7) || '.py'
             ELSE 'Hello, my name is ' || (['Alice', 'Bruno', 'Carla', 'Dmitri', 'Elena'])[user_id % 5 + 1] || '.' END AS content
        FROM e LEFT JOIN part p ON p.p_partkey = e.event_id % (SELECT parts FROM parts))"""
OPERATIONS = EVENTS + """,
  o AS (SELECT event_id, user_id AS session_id, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'edit' END AS op, 'src/m' || (user_id % 7) || '.py' AS file_path, ts,
        CASE WHEN event_type = 'purchase' THEN 'a = ' || k || chr(10) || 'b = ' || (k % 10) END AS content,
        CASE WHEN event_type = 'click' THEN 'b = ' || (k % 10) END AS old_string, CASE WHEN event_type = 'click' THEN 'b = ' || (k % 7) END AS new_string,
        event_id % 3 = 0 AS replace_all FROM e WHERE event_type IN ('purchase', 'click'))"""
_LITERAL = lambda text: "'" + text.replace("'", "''") + "'"
SAID = EVENTS + f""",
  sm AS (SELECT user_id * 4 + (day(ts) - 1) // 8 AS session_id, event_id, ts, k, user_id, ([{", ".join(_LITERAL(r) for r, _ in SENTENCES)}])[event_id % {len(SENTENCES)} + 1] AS role,
         ([{", ".join(_LITERAL(t) for _, t in SENTENCES)}])[event_id % {len(SENTENCES)} + 1] AS text FROM e),
  s AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS msg_idx, event_id, role, ts,
        replace(replace(text, '{{k}}', k::VARCHAR), '{{p}}', 'src/m' || (user_id % 7) || '.py') AS content FROM sm)"""

LINES = EVENTS + """,
  l AS (SELECT user_id::VARCHAR AS session_id, '-home-p' || (user_id % 3) AS project, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line, event_id, event_type, ts, k, 'src/m' || (user_id % 7) || '.py' AS path FROM e)"""


def matches(rows: str, patterns: list[tuple], text: str = "content", columns: str = "session_id, msg_idx") -> str:
    """SQL for all matches of patterns: (pattern, group, {column: constant}); place is the pattern's number, pos the match's."""
    parts = []
    for i, (pattern, group, extra) in enumerate(patterns):
        more = "".join(f", {_LITERAL(v) if isinstance(v, str) else f'{v}::DOUBLE'} AS {c}" for c, v in extra.items())
        parts.append(f"SELECT {columns}, {i} AS place{more}, unnest(regexp_extract_all({text}, {_LITERAL(pattern)}, {group})) AS found, generate_subscripts(regexp_extract_all({text}, {_LITERAL(pattern)}, {group}), 1) AS pos FROM {rows}")
    return " UNION ALL ".join(parts)


def strip(text: str) -> str:
    """SQL for a text without white space at its ends."""
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_LITERAL(w)})" for w in words) + ")"


def starts(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {_LITERAL(w)})" for w in words) + ")"


def letters(text: str) -> str:
    return rf"length(regexp_replace({text}, '[^\p{{L}}\s]', '', 'g')) / greatest(1, length({text}))::DOUBLE"


TURNS = "t AS (SELECT conv_id AS session_id, turn AS msg_idx, role, text AS content, to_timestamp(1704067200 + conv_id % 365 * 86400) AT TIME ZONE 'UTC' AS ts FROM conversations)"
AS_OF = "TIMESTAMP '2024-12-31 00:00:00'"
