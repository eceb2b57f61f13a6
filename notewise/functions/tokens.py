"""Token and n-gram column functions.

Native Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: tokenizer rules
# ROUGE tokenizer (no stemming): lower-case, every run outside [a-z0-9] is a
# separator, empty pieces dropped.
ROUGE_SEPARATOR = "[^a-z0-9]+"
ROUGE_LINE_SEPARATOR = "[^a-z0-9\\n]+"
# Default token counter for budgets (not a sub-word count): a special chat
# marker, an ASCII alphanumeric run, or any other single non-blank character.
COUNT_TOKEN_PATTERN = r"<\|[a-z_]+\|>|[0-9A-Za-z]+|[^0-9A-Za-z \t\r\n]"
# --- end fixed values


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rouge_tokens(c) -> Column:
    """ROUGE tokens of a text (array<string>, empty for NULL-free text
    without ASCII alphanumerics)."""
    spaced = F.regexp_replace(F.lower(_c(c)), ROUGE_SEPARATOR, " ")
    return F.filter(F.split(spaced, " "), lambda x: x != F.lit(""))


def scoring_text(c) -> Column:
    """A text as its ROUGE tokens, one blank between two, line ends kept (the
    summary-level LCS reads lines): what the scoring UDF splits."""
    return F.regexp_replace(F.lower(_c(c)), ROUGE_LINE_SEPARATOR, " ")


def ngrams(tokens, n: int) -> Column:
    """R2: contiguous n-grams of a token array, joined by one space."""
    def body(t):
        # sequence(0, size) never counts down here; positions past size-n drop out
        starts = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: i + n <= F.size(t))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, n), " "))
    return let(_c(tokens), body)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` as a lambda variable.

    Column expressions are inlined where used; inside a higher-order
    function an inlined array would be recomputed per element. A one-element
    transform evaluates it once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def count_tokens(c, pattern: str = COUNT_TOKEN_PATTERN) -> Column:
    """T2 default counter: number of pattern matches in the text."""
    return F.regexp_count(_c(c), F.lit(pattern))


def budget_tokens(c, pattern: str = COUNT_TOKEN_PATTERN) -> Column:
    """The tokens themselves (array<string>) for truncation and labels."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)
