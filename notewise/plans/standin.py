"""A deterministic stand-in for a model: the responder behind the registered
generation queries, and a clock to go with it. They prove the batch plumbing;
they are no model."""

from __future__ import annotations

import re

from notewise.functions.tokens import COUNT_TOKEN_PATTERN


def extractive_responder(chats: list, settings: dict) -> list:
    """First answer: the note's sentences as a semicolon list. Every later
    answer: the previous answer without its last item (one item stays)."""
    out = []
    for chat in chats:
        prev = next((m["content"] for m in reversed(chat) if m["role"] == "assistant"), None)
        if prev is None:
            note = next((m["content"] for m in chat if m["role"] == "user"), "") or ""
            out.append(note.replace(". ", "; "))
        else:
            items = prev.split("; ")
            out.append("; ".join(items[:max(len(items) - 1, 1)]))
    return out


#: the request after a rejected answer
AGAIN = "List the points, separated by semicolons."


def correcting_responder(chats: list, settings: dict) -> list:
    """As ``extractive_responder``; after the request ``AGAIN`` the note's first
    words as a list, one word more each time."""
    out = []
    for chat in chats:
        asked = sum(m["role"] == "user" and m["content"] == AGAIN for m in chat)
        note = next((m["content"] for m in chat if m["role"] == "user"), "") or ""
        out.append("; ".join(note.split(" ")[:asked + 1]) if asked else note.replace(". ", "; "))
    return out


def regex_ids(texts: list) -> list:
    """Token ids of the default counter's tokens: a token's length and first
    code point in one number. Stands in for a tokenizer in the registered
    queries."""
    pattern = re.compile(COUNT_TOKEN_PATTERN)
    return [[len(t) * 65_536 + ord(t[0]) % 65_536 for t in pattern.findall(x)] for x in texts]


class WorkClock:
    """A clock that a responder moves: ``sec_per_chat`` for each chat that it
    answers, so that timings can be checked to the digit."""

    def __init__(self, sec_per_chat: float):
        self.sec_per_chat, self.now = sec_per_chat, 0.0

    def __call__(self) -> float:
        return self.now

    def timed(self, fn):
        def respond(chats, settings):
            self.now += self.sec_per_chat * len(chats)
            return fn(chats, settings)
        return respond
