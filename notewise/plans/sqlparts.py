"""DuckDB SQL fragments for the oracle queries (the same rules as the
Spark column functions, written in the other engine's dialect)."""

from __future__ import annotations

from notewise.functions.text import PY_WHITESPACE
from notewise.plans.prompts import (BOS, EOT, HDR_END, HDR_START, INST_BOS, INST_CLOSE,
                                    INST_OPEN, SYSTEM_CONCISE, SYSTEM_COVERAGE)

WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
NL = "chr(10)"
COUNT_PATTERN = r"'<\|[a-z_]+\|>|[0-9A-Za-z]+|[^0-9A-Za-z \t\r\n]'"


def lit(s: str) -> str:
    """A SQL string literal (newlines spelled with chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, {NL}, ' '), ' +', ' ', 'g'), {WS})"


def tok(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def ngr(t: str, n: int) -> str:
    return (f"list_transform(range(0, greatest(len({t}) - {n} + 1, 0)), "
            f"lambda i: array_to_string({t}[i + 1:i + {n}], ' '))")


def overlap(a: str, b: str) -> str:
    """Multiset intersection size of two lists: count per value on each
    side, join on the value, sum the smaller counts."""
    return (f"coalesce((SELECT sum(least(x.n, y.n)) FROM "
            f"(SELECT g, count(*) AS n FROM unnest({a}) AS t(g) GROUP BY g) x JOIN "
            f"(SELECT g, count(*) AS n FROM unnest({b}) AS t(g) GROUP BY g) y USING (g)), 0)")


def fm(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def padded(x: str) -> str:
    return f"({NL} || '    ' || {x} || {NL} || '    ')"


def llama_msg(role: str, content_sql: str) -> str:
    return (f"{lit(HDR_START + role + HDR_END)} || {NL} || {NL} || trim({content_sql}, {WS}) || "
            f"{lit(EOT)}")


def training_text(note: str, answer: str) -> str:
    return (f"({lit(BOS)} || {llama_msg('system', lit(SYSTEM_CONCISE))} || "
            f"{llama_msg('user', padded(note))} || {llama_msg('assistant', answer)})")


def generation_prompt(note: str) -> str:
    return (f"({lit(BOS)} || {llama_msg('system', lit(SYSTEM_CONCISE))} || "
            f"{llama_msg('user', padded(note))} || {lit(HDR_START + 'assistant' + HDR_END)} || "
            f"{NL} || {NL})")


def inst_single(user_sql: str) -> str:
    return f"({lit(INST_BOS + INST_OPEN)} || {user_sql} || {lit(INST_CLOSE)})"


def count_tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {COUNT_PATTERN})) AS BIGINT)"


def json_msgs(*pairs: tuple[str, str]) -> str:
    """to_json of a message list; pairs are (role literal, content SQL)."""
    items = ", ".join(f"{{'role': '{r}', 'content': {c}}}" for r, c in pairs)
    return f"CAST(to_json([{items}]) AS VARCHAR)"


SYS_COVERAGE = lit(SYSTEM_COVERAGE)
