"""Prompt texts, chat markers, the step plan and run settings.

Prompt wording is our own (the model-facing text is configuration, not a
value results depend on). The chat markers are fixed values of the public
chat templates and must match them exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: chat template markers (public Llama-3 / Mistral-instruct templates)
BOS = "<|begin_of_text|>"
HDR_START = "<|start_header_id|>"
HDR_END = "<|end_header_id|>"
EOT = "<|eot_id|>"
PAD = "<|pad|>"
INST_BOS = "<s>"
INST_EOS = "</s>"
INST_OPEN = "[INST] "
INST_CLOSE = " [/INST]"
LABEL_IGNORE = -100          # label value excluded from the loss
TOKEN_BUDGET = 512           # max_seq_length of the fine-tuning runs
# --- end fixed values

# Default instruction for records whose source has no system turn.
DEFAULT_INSTRUCTION = "List the main findings of the text, with a semicolon between items."

# System prompts: plain defaults of our own.
SYSTEM_CONCISE = "Answer with the main findings of the text as one short list; put a semicolon between items."
SYSTEM_COVERAGE = "Answer with all findings that the text supports, as a list."
SYSTEM_FLOW = "You work on one text over several turns. " + SYSTEM_COVERAGE

# Follow-up turns of the built-in flows.
FOLLOW_SHORTEN = "Keep the items that matter most."
FOLLOW_REVISE = "Compare the list with the text. Add what is missing, remove what is wrong, answer with the list alone."
FOLLOW_RANK = "Sort the items by how sure you are of them."
FOLLOW_REFLECT = "Read the text again and improve the list where it needs it."
FOLLOW_REFLECT_AGAIN = "Read the text once more and improve the list where it needs it."
FOLLOW_CHECK = "Test each item against the text and leave out the weak ones."
FOLLOW_FINAL = "Give the final list."


#: Built-in flows: the follow-up turns that a step shows, oldest first. The
#: first flow shows some turns in other words later on than when they were
#: put; "consistent" shows them as they were.
FLOW_TURNS = {
    "as_reference": {
        1: [],
        2: [FOLLOW_REVISE],
        3: [FOLLOW_RANK, FOLLOW_REFLECT],
        4: [FOLLOW_RANK, FOLLOW_REFLECT_AGAIN, FOLLOW_CHECK],
        5: [FOLLOW_RANK, FOLLOW_REFLECT_AGAIN, FOLLOW_CHECK, FOLLOW_FINAL],
    },
    "consistent": {
        1: [],
        2: [FOLLOW_REVISE],
        3: [FOLLOW_REVISE, FOLLOW_REFLECT],
        4: [FOLLOW_REVISE, FOLLOW_REFLECT, FOLLOW_CHECK],
        5: [FOLLOW_REVISE, FOLLOW_REFLECT, FOLLOW_CHECK, FOLLOW_FINAL],
    },
}


def flow_plan(turns: dict[int, list[str]], system: str = SYSTEM_FLOW) -> list[tuple]:
    """Plan rows (step, msg_idx, role, source, content) of a flow in which
    each step shows the system prompt, the note, and then, for each follow-up
    turn, the answer before it and the turn."""
    rows = []
    for step, follow in turns.items():
        msgs = [("system", "lit", system), ("user", "note", None)]
        for k, text in enumerate(follow, 1):
            msgs += [("assistant", f"out{k}", None), ("user", "lit", text)]
        rows += [(step, i, *m) for i, m in enumerate(msgs)]
    return rows


#: A shorter flow, of three steps, as a user might write it.
SHORT_PLAN = flow_plan({1: [], 2: [FOLLOW_SHORTEN], 3: [FOLLOW_SHORTEN, FOLLOW_FINAL]})


def prompt_plan_rows(flows=("as_reference", "consistent")) -> list[tuple]:
    """(flow, step, msg_idx, role, source, content) of built-in flows."""
    return [(f, *row) for f in flows for row in flow_plan(FLOW_TURNS[f])]


RUN_CONFIG_SCHEMA = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("max_new_tokens", T.IntegerType(), False),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("top_p", T.DoubleType(), False),
    T.StructField("scored_step", T.IntegerType(), False),
])

# Single prompt 512 / 0.4 / 0.95; refinement flow the same, scored at
# step 2; short demo 256 / 0.6 / 0.9; training smoke run 128 tokens.
RUN_CONFIG_ROWS = [
    ("single_prompt", 512, 0.4, 0.95, 1),
    ("flow", 512, 0.4, 0.95, 2),
    ("demo", 256, 0.6, 0.9, 1),
    ("sft_smoke", 128, 1.0, 1.0, 1),
    ("to_final", 512, 0.4, 0.95, 2),
    ("to_next", 512, 0.4, 0.95, 1),
]


def run_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUN_CONFIG_ROWS, RUN_CONFIG_SCHEMA)


def settings_for(method: str) -> dict:
    """Generation settings of one method, as handed to a responder."""
    for m, max_new, temp, top_p, _ in RUN_CONFIG_ROWS:
        if m == method:
            return {"max_new_tokens": max_new, "temperature": temp, "top_p": top_p,
                    "do_sample": True}
    raise KeyError(method)
