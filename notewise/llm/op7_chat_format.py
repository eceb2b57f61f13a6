"""Chat formatting by schema fingerprints.

A record is JSON in any layout: rows with a role, message lists, prompt and
response, instruction / input / output, nested parts. Its *fingerprint* is a
hash over the sorted set of its nested field paths (list positions left
out). The fingerprint selects a declarative mapping (``LAYOUTS``), which says
where the turns lie and which field holds the role and the text; a record
whose fingerprint no layout claims goes to the layout whose required paths
it holds (most paths first), or else yields one turn of role ``unknown``
with the record's own JSON as text, so nothing is lost.

Canonical turns are formatted by a template that marks turns,

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and escapes control strings inside texts and roles reversibly: a backslash
doubles, and every control string gets ``\\-`` after its first character.
The loss mask covers the text of each assistant turn.

``format_turns`` deals conversations out by id, sorts by turn and streams:
a conversation of any length passes through in constant memory, turn by
turn. ``read_back`` parses the formatted pieces again and derives digests.

Edge cases: null text and null role are empty; turns are ordered by turn
(null last), then by their place in the record, then role and text, so
repeated rows stay and reruns agree; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

START, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat formats; fixed values.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
           "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>",
           "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(STOP) + r"\n", re.S)

#: Mappings: paths that must be there (lists as []), and the turns they give.
#: ``each``: the list of turns; ``role`` and ``text``: fields of one of them.
#: ``fixed``: turns of given roles, each joined of fields that hold a text.
LAYOUTS = [
    {"name": "row", "paths": ["role", "text"], "role": "role", "text": "text"},
    {"name": "row_content", "paths": ["content", "role"], "role": "role", "text": "content"},
    {"name": "row_from", "paths": ["from", "value"], "role": "from", "text": "value"},
    {"name": "messages", "paths": ["messages[].content", "messages[].role"], "each": "messages",
     "role": "role", "text": "content"},
    {"name": "messages_parts", "paths": ["messages[].content[].text", "messages[].role"], "each": "messages",
     "role": "role", "text": "content[].text"},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "each": "conversations",
     "role": "from", "text": "value"},
    {"name": "mapping_author", "paths": ["turns[].author.role", "turns[].content.parts[]"], "each": "turns",
     "role": "author.role", "text": "content.parts[]"},
    {"name": "instruction", "paths": ["instruction", "output"],
     "fixed": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "prompt_response", "paths": ["prompt", "response"],
     "fixed": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt_completion", "paths": ["completion", "prompt"],
     "fixed": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question_answer", "paths": ["answer", "question"],
     "fixed": [("user", ["context", "question"]), ("assistant", ["answer"])]},
]
#: Speakers of from / value layouts -> roles; any other stays as it is.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, list positions left out."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


EXACT = {fingerprint(set(x["paths"])): x for x in LAYOUTS}


def layout_for(found: set[str]) -> dict | None:
    """By fingerprint; for a record with further fields, by the largest set
    of required paths that it holds."""
    exact = EXACT.get(fingerprint(found))
    if exact:
        return exact
    held = [x for x in LAYOUTS if set(x["paths"]) <= found]
    return max(held, key=lambda x: len(x["paths"]), default=None)


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _pick(value, path: str) -> str:
    """Text at a path; several under a list are joined by newlines."""
    for i, key in enumerate(path.split(".")):
        lists = key.endswith("[]")
        value = value.get(key.removesuffix("[]")) if isinstance(value, dict) else None
        if lists:
            rest = ".".join(path.split(".")[i + 1:])
            items = value if isinstance(value, list) else []
            return "\n".join(_pick(x, rest) if rest else _text(x) for x in items)
    return _text(value)


def canonical(record: str | None, known: dict) -> list[tuple[str, str]]:
    """(role, text) turns of a JSON record; ``known`` keeps the layout of
    each set of paths met. A record that is no JSON, or nested deeper than the
    JSON reader goes, is one turn of role ``unknown``."""
    try:
        return _canonical(record, known)
    except RecursionError:
        return [("unknown", record)]


def _canonical(record: str | None, known: dict) -> list[tuple[str, str]]:
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return [("unknown", record)]
    if value is None:
        return []
    found = frozenset(paths(value))
    if found not in known:
        if len(known) > 10_000:
            known.clear()
        known[found] = layout_for(set(found))
    layout = known[found]
    if layout is None:
        return [("unknown", record)]
    if "fixed" in layout:
        held = [(role, "\n".join(_text(value[f]) for f in fields if value.get(f) not in (None, "")))
                for role, fields in layout["fixed"]]
        return [(role, text) for role, text in held if text or role != "system"]
    items = value[layout["each"]] if "each" in layout else [value]
    names = SPEAKERS if layout["role"] == "from" else {}
    return [(names.get(r := _pick(x, of["role"]), r), _pick(x, of["text"]))
            for x, of in zip(items, _item_layouts(items, layout, found))]


def _item_layouts(items: list, layout: dict, found: frozenset) -> list[dict]:
    """The layout of each turn of a list: the record's own, unless the record
    holds the paths of several, as lists of texts and of parts do when mixed;
    then the one whose paths the turn itself holds."""
    held = [x for x in LAYOUTS if "each" in x and x["each"] == layout.get("each") and set(x["paths"]) <= found]
    if len(held) < 2:
        return [layout] * len(items)
    return [next((x for x in held if set(x["paths"]) <= paths(item, f"{layout['each']}[]")), layout) for item in items]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted piece, start and end of the loss mask in it)."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    on = role == "assistant"
    return head + body + STOP + "\n", len(head) if on else 0, len(head) + len(body) if on else 0


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted piece."""
    m = _PIECE.fullmatch(piece)
    return unescape(m[1]), unescape(m[2])


def row_records(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Records (key, ord, record) of a table with a row for each turn."""
    record = F.to_json(F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))
    return df.select(F.col(key).alias("conv_id"), F.col(order).cast("bigint").alias("ord"), record.alias("record"))


PIECES = "conv_id bigint, ord bigint, place int, role string, formatted string, loss_from int, loss_to int"


def format_turns(records: DataFrame) -> DataFrame:
    """Formatted pieces of (conv_id, ord, record) JSON records, a row per
    turn; in the order of (ord, place, formatted) they are the conversation."""
    C.ship_package(records.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("ord", pa.int64()), ("place", pa.int32()), ("role", pa.string()),
                        ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])

    def run(batches):
        known: dict = {}
        for b in batches:
            rows = []
            for conv, ord_, rec in C.rows_of([b], "conv_id", "ord", "record"):
                for place, (role, text) in enumerate(canonical(rec, known)):
                    rows.append((conv, ord_, place, role, *format_turn(role, text)))
            yield C.record(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    return records.select(F.col("conv_id").cast("bigint"), "ord", "record").mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars), parsed from the formatted pieces alone. Pieces of a
    conversation stream through in order; only running digests are held."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, state = None, None
        done = []

        def close():
            if state is not None:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, piece, lo, hi in C.rows_of([b], "conv_id", "formatted", "loss_from", "loss_to"):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(piece[lo:hi])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield C.record(schema, *zip(*done))
                done.clear()
        close()
        if done:
            yield C.record(schema, *zip(*done))

    return (pieces.repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("ord").asc_nulls_last(), "place", "role", "formatted")
            .select("conv_id", "formatted", "loss_from", "loss_to")
            .mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                             "loss_sha256 string, formatted_chars bigint"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """Format all conversations, and conversation -1, a message list."""
    say = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": r, "content": say} for r in ("user", "assistant")]})
    records = row_records(C.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("ord"),
                                 F.lit(extra).alias("record"))
    return read_back(format_turns(records.unionByName(more)))


def _sql_escaped_length(c: str) -> str:
    controls = "|".join(re.escape(x).replace("'", "''") for x in CONTROL)
    return f"(len({c}) + len({c}) - len(replace({c}, '\\', '')) + 2 * len(regexp_extract_all({c}, '{controls}')))"


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
agg AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({len(START) + len(STOP) + 2} + {_sql_escaped_length('role')} + len(role) - len(replace(role, chr(10), ''))
             + {_sql_escaped_length('text')}) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM agg
"""
