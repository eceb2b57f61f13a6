"""Chat messages and chat templates as columns.

A chat is ``array<struct<role string, content string>>``. Messages are built
with ``array(struct(...))`` and rendered with ``transform`` + ``array_join``;
no Python on the data path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewise.functions.text import PY_WHITESPACE, padded_prompt, single_prompt
from notewise.plans.prompts import (BOS, EOT, HDR_END, HDR_START, INST_BOS, INST_CLOSE,
                                    INST_EOS, INST_OPEN, SYSTEM_CONCISE, SYSTEM_COVERAGE)

MESSAGE = "struct<role:string,content:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).cast("string").alias("content"))


def messages_user(instruction="instruction", note="input") -> Column:
    """One user message holding instruction + note."""
    return F.array(message("user", single_prompt(instruction, note)))


def messages_system_user(note="input", system: str = SYSTEM_COVERAGE) -> Column:
    """Fixed system prompt, then the note (the record's own instruction
    is not used)."""
    return F.array(message("system", F.lit(system)), message("user", note))


def messages_training(note="input", answer="output", system: str = SYSTEM_CONCISE) -> Column:
    """System, padded note, gold answer."""
    return F.array(message("system", F.lit(system)), message("user", padded_prompt(note)),
                   message("assistant", answer))


def messages_generation(note="input", system: str = SYSTEM_CONCISE) -> Column:
    """System and padded note, no answer."""
    return F.array(message("system", F.lit(system)), message("user", padded_prompt(note)))


def render_llama3(messages="messages", add_generation_prompt: bool = False) -> Column:
    """Header-marked chat text. Content is stripped of surrounding
    whitespace (the template's trim), so P5 padding disappears here."""
    body = F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.lit(HDR_START), m["role"], F.lit(HDR_END + "\n\n"),
        F.trim(m["content"], F.lit(PY_WHITESPACE)), F.lit(EOT))), "")
    out = F.concat(F.lit(BOS), body)
    if add_generation_prompt:
        out = F.concat(out, F.lit(f"{HDR_START}assistant{HDR_END}\n\n"))
    return out


def render_inst(messages="messages") -> Column:
    """Bracketed instruct format. User and assistant turns must
    alternate starting with user; any other shape raises."""
    msgs = _c(messages)
    bad = F.exists(F.transform(msgs, lambda m, i: F.struct(m["role"].alias("r"), i.alias("i"))),
                   lambda x: (x["r"] == "user") != (x["i"] % 2 == 0))
    other = F.exists(msgs, lambda m: ~m["role"].isin("user", "assistant"))
    body = F.array_join(F.transform(msgs, lambda m: F.when(
        m["role"] == "user", F.concat(F.lit(INST_OPEN), m["content"], F.lit(INST_CLOSE)))
        .otherwise(F.concat(m["content"], F.lit(INST_EOS)))), "")
    return (F.when(other, F.raise_error(F.lit("only user and assistant roles are supported")))
            .when(bad, F.raise_error(F.lit("roles must alternate user/assistant")))
            .otherwise(F.concat(F.lit(INST_BOS), body)))


def messages_to_json(messages="messages") -> Column:
    return F.to_json(_c(messages))
