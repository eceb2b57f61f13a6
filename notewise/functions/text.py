"""Text column functions.

All are plain Catalyst expressions: they stay inside whole-stage codegen
(or interpreted higher-order functions for the array ones), never Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewise.plans.prompts import EOT, INST_EOS

# Every code point Python's str.strip() removes (str.isspace()), derived by rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Newline -> space, runs of U+0020 -> one space, strip Unicode
    whitespace at both ends (tabs, CR and NBSP inside are kept)."""
    x = F.regexp_replace(F.translate(_c(c), "\n", " "), " +", " ")
    return F.trim(x, F.lit(PY_WHITESPACE))


def clean_scope(df, scope=("instruction", "input")):
    """Clean a chosen subset of text fields (none, some or all)."""
    return df.withColumns({f: clean_text(f) for f in scope}) if scope else df


def single_prompt(instruction="instruction", note="input") -> Column:
    """Instruction, one space, note (NULL if either is NULL)."""
    return F.concat(_c(instruction), F.lit(" "), _c(note))


def padded_prompt(note="input") -> Column:
    """P5: the note between a newline and four spaces on each side."""
    return F.concat(F.lit("\n    "), _c(note), F.lit("\n    "))


def answer_vs_prediction(answer="output", prediction="candidate") -> Column:
    """The preview block printed next to a generation."""
    return F.concat(F.lit("\nanswer: "), _c(answer), F.lit("\nprediction: "),
                    _c(prediction), F.lit("\n"))


def parse_list(c, sep: str = ";") -> Column:
    """a separated answer as an array of trimmed, non-empty items."""
    items = F.transform(F.split(_c(c), sep), lambda x: F.trim(x, F.lit(PY_WHITESPACE)))
    return F.filter(items, lambda x: x != F.lit(""))


def extract_last_message(messages="messages") -> Column:
    """Content of the last message of a chat (NULL for an empty chat)."""
    return F.try_element_at(_c(messages), F.lit(-1))["content"]


def strip_prompt(decoded="decoded", prompt="prompt") -> Column:
    """The new text of a whole decoded sequence: drop the rendered prompt
    when the sequence starts with it, keep the text as is otherwise."""
    d, p = _c(decoded), _c(prompt)
    rest = d.substr(F.length(p) + 1, F.length(d))
    return F.when(d.startswith(p), rest).otherwise(d)


def cut_at_terminator(c, markers=(EOT, INST_EOS)) -> Column:
    """Answer up to the first end-of-turn or end-of-sequence marker."""
    out = _c(c)
    for m in markers:
        out = F.substring_index(out, m, 1)
    return out


def null_flags(cols) -> list[Column]:
    """one boolean per column, true where the cell is NULL."""
    return [F.isnull(c).alias(f"{c}_null") for c in cols]
