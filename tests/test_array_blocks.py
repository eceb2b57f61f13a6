"""JSON array files read in blocks, against the whole-file parse."""

import json
import os
import random
import tempfile

import pytest

from notewise.sources import array_blocks as AB
from notewise.sources import records as SR

TRICKY = ['plain', 'a "quoted" } brace', 'back\\slash', 'ends in backslash \\', '\\"', '[1, {"x": 2}], {', '}}}{{{', '', 'é漢😀',
          'line\nbreak', ',', '\\\\"},{"', 'x' * 300]


def write(texts: dict) -> str:
    folder = tempfile.mkdtemp(prefix="nw-arrays-", dir="/tmp")
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return folder


def elements(spark, folder, block):
    rows = AB.array_elements(spark, folder, block_bytes=block).collect()
    out = {}
    for r in rows:
        out.setdefault(r.source_file.rsplit("/", 1)[-1], []).append((r.pos, r.bad_file or r.text))
    return {k: [v for _, v in sorted(vs, key=lambda x: (x[0] is not None, x[0]))] for k, vs in out.items()}


@pytest.mark.parametrize("block", [40, 333, None])
def test_blocks_give_the_whole_files_elements(spark, block):
    rng = random.Random(7)
    files = {}
    for i in range(3):
        objs = [{"instruction": rng.choice(TRICKY), "input": rng.choice(TRICKY), "output": rng.choice(TRICKY),
                 "more": rng.choice([None, [1, [2, {"y": rng.choice(TRICKY)}]], {"z": {"w": []}}, 5, True])} for _ in range(25)]
        files[f"{i}.json"] = json.dumps(objs, indent=rng.choice([None, 2]), ensure_ascii=bool(i % 2)) + "\n" * (i % 2)
    got = elements(spark, write(files), block)
    assert {k: [json.loads(x) for x in v] for k, v in got.items()} == {k: json.loads(v) for k, v in files.items()}


@pytest.mark.parametrize("block", [8, None])
def test_odd_files(spark, block):
    files = {"empty.json": "[]", "blank.json": " [ \n ] ", "object.json": '{"a": [1, 2]}', "text.json": '"x"', "open.json": '[{"a": 1}, {"b"',
             "quote.json": '[{"a": "1}, {"b": 2}]', "two.json": '[{"a":1}] [{"b":2}]', "after.json": '[{"a":1}]}', "lead.json": 'x [{"a":1}]',
             "one.json": '[{"a":1}]', "numbers.json": "[1, 2,3 ]", "hole.json": '[{"a":1},,{"b":2}]', "tail.json": '[{"a":1},]'}
    got = elements(spark, write(files), block)
    assert "empty.json" not in got and "blank.json" not in got
    for name in ("open", "quote", "two", "after", "lead"):
        assert got[f"{name}.json"] == ["malformed"], name
    assert got["object.json"] == ["not_an_array"] and got["text.json"] == ["not_an_array"]
    assert got["one.json"] == ['{"a":1}'] and [x.strip() for x in got["numbers.json"]] == ["1", "2", "3"]
    assert [x.strip() for x in got["hole.json"]] == ['{"a":1}', "", '{"b":2}'] and len(got["tail.json"]) == 2


def test_a_broken_element_is_rejected_alone(spark):
    good = {"instruction": "i", "input": "a } b", "output": "o"}
    text = "[" + ",".join([json.dumps(dict(good, id=1)), '{"id": 2, "input": tru, "output": "o"}', json.dumps(dict(good, id=3))]) + "]"
    folder = write({"a.json": text})

    def parse(spark, path, id_key=None):
        return AB.parse_record_blocks(spark, path, id_key, block_bytes=24)
    kept = SR.read_records(spark, folder, id_key="id", mode="quarantine", parse=parse).collect()
    assert sorted(r.record_id for r in kept) == [1, 3]
    bad = SR.rejects(spark, folder, id_key="id", parse=parse).collect()
    assert [(r.reason, json.loads(r.raw.replace("tru,", "1,"))["id"]) for r in bad] == [("malformed", 2)]
    # the whole-file parse loses the file
    assert SR.rejects(spark, folder, id_key="id").collect()[0].reason == "malformed"


def test_many_tasks_read_one_file(spark):
    objs = [{"instruction": "i", "input": f"text {i}", "output": "o"} for i in range(2000)]
    folder = write({"big.json": json.dumps(objs)})
    with AB._blocks_of(spark, 4096):
        parts = spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions()
    assert parts > 10
    rows = AB.parse_record_blocks(spark, folder, block_bytes=4096).select("pos", "record_id").collect()
    assert sorted(r.pos for r in rows) == list(range(2000)) and len({r.record_id for r in rows}) == 2000
    whole = SR.parse_record_files(spark, folder).select("pos", "record_id").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))
