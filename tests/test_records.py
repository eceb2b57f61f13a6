import json
import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notewise.operators import evaluate as E
from notewise.operators import rouge as R
from notewise.sources import records as SR


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="nw-rec-", dir="/tmp")


def test_edge_rows_quarantine(spark, folder):
    rows = [
        {"instruction": "i", "input": "\ta  b\n", "output": "o", "extra": 1},
        {"instruction": "i", "input": "a"},                               # key missing
        {"instruction": "i", "input": None, "output": "o"},               # JSON null input
        {"instruction": "i", "input": "n", "output": None},               # null output kept
    ]
    _write(folder, "a.json", json.dumps(rows))
    v = SR.validate_records(SR.parse_record_files(spark, folder)).orderBy("pos").collect()
    assert [r.reason for r in v] == [None, "missing_key", "null_field", None]
    good = {r.record_id: r for r in SR.read_records(spark, folder, mode="quarantine").collect()}
    assert set(good) == {v[0].record_id, v[3].record_id}
    assert good[v[0].record_id].input == "a b"            # cleaned while loading
    assert good[v[3].record_id].output is None


def test_fields_must_be_text(spark, folder):
    full = {"instruction": "i", "input": "a", "output": "o"}
    rows = [full] + [{**full, key: bad} for key in full for bad in (5, 2.5, True, ["x"], {"a": 1})]
    _write(folder, "a.json", json.dumps(rows))
    v = SR.validate_records(SR.parse_record_files(spark, folder)).orderBy("pos").collect()
    assert [r.reason for r in v] == [None] + ["not_text"] * 15
    with pytest.raises(PySparkException):
        SR.read_records(spark, folder).collect()


def test_fail_mode_raises(spark, folder):
    _write(folder, "a.json", json.dumps([{"instruction": "i", "input": "a"}]))
    with pytest.raises(PySparkException):
        SR.read_records(spark, folder, mode="fail").collect()


def test_malformed_and_empty_files(spark, folder):
    _write(folder, "bad.json", "[{bad")
    _write(folder, "empty.json", "[]")
    rej = SR.rejects(spark, folder).collect()
    assert [r.reason for r in rej] == ["malformed"]
    assert SR.read_records(spark, folder, mode="quarantine").count() == 0


def test_empty_input_gives_zero_rows_and_null_ratio(spark, folder):
    _write(folder, "empty.json", "[]")
    recs = SR.read_records(spark, folder).withColumn("split", F.lit("train")) \
        .withColumn("token_count", F.lit(1))
    from notewise.operators.sft import length_report
    assert length_report(recs).count() == 0


def test_multi_file_ids_are_unique_and_stable(spark, folder):
    for k in range(3):
        _write(folder, f"p{k}.json", json.dumps([{"instruction": "i", "input": str(j), "output": "o"}
                                                 for j in range(4)]))
    r = SR.read_records(spark, folder).collect()
    ids = sorted(x.record_id for x in r)
    assert len(set(ids)) == 12
    assert sorted(x.record_id for x in SR.read_records(spark, folder).collect()) == ids


def test_jsonl_lines_malformed(spark, folder):
    _write(folder, "l.jsonl", '{"id": 1, "instruction": "i", "input": "a", "output": "o"}\n{oops\n')
    got = SR.read_record_lines(spark, folder).orderBy("record_id").collect()
    assert sorted([str(r.reason) for r in got]) == ["None", "malformed"]


def test_write_arrays_roundtrip(spark, folder):
    df = spark.createDataFrame([(i, "ins", f"in {i}", None if i == 2 else "o") for i in range(10)],
                               "record_id long, instruction string, input string, output string")
    path = os.path.join(folder, "arr")
    SR.write_record_arrays(df, path, chunk=4)
    back = SR.read_records(spark, path, id_key="id").orderBy("record_id").collect()
    assert [r.record_id for r in back] == list(range(10))
    assert back[2].output is None


def test_written_arrays_are_bounded_files_side_by_side(spark, folder):
    ids = [None, None, 5, 5, 10 ** 15, -3, 7, 8, 9]                    # NULL, repeated and sparse ids
    df = spark.createDataFrame([(i, "ins", "x" * 40, "o") for i in ids],
                               "record_id long, instruction string, input string, output string").coalesce(1)
    for name, kw, n_files in (("rows", {"chunk": 4}, 3), ("bytes", {"chunk_bytes": 100}, 9)):
        path = os.path.join(folder, name)
        SR.write_record_arrays(df, path, **kw)
        files = [f for f in os.listdir(path) if f.startswith("part-")]
        assert len(files) == n_files and not [f for f in os.listdir(path) if "=" in f]
        assert SR.read_records(spark, path, id_key="id").count() == len(ids)


def test_outputs_without_gold_are_stored(spark, folder):
    resp = spark.createDataFrame([("m", 1, 1, "a"), ("m", 1, 2, "b"), ("m", 1, None, "c")],
                                 "method string, step int, record_id long, candidate string")
    gold = spark.createDataFrame([(1, "x")], "record_id long, output string")
    SR.save_outputs(resp, gold, os.path.join(folder, "out"))
    back = spark.read.parquet(os.path.join(folder, "out")).collect()
    assert sorted((r.candidate, r.output) for r in back if r.output) == [("a", "x")] and len(back) == 3


def test_duplicate_gold_fails(spark):
    cand = spark.createDataFrame([(1, "a"), (2, "b")], "record_id long, candidate string")
    gold = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "record_id long, output string")
    with pytest.raises(PySparkException):
        E.pair_with_gold(cand, gold).collect()


def _fails_for_every_reader(pairs):
    for read in (lambda d: d.count(), lambda d: d.select("reference").collect(), lambda d: d.collect(),
                 lambda d: E.corpus_rouge(R.score_pairs(d, metrics=("rouge1", "rouge2"))).collect()):
        with pytest.raises(PySparkException, match="answer without gold|gold without|NULL key|records|twice"):
            read(pairs)


RUN = "method string, step int, record_id long, candidate string"
GOLD = "record_id long, output string"


@pytest.mark.parametrize("cand, gold", [
    ([("m", 1, 1, "a"), ("m", 1, 2, "b"), ("m", 1, 3, "c")], [(1, "x"), (2, "y")]),      # answer without gold
    ([("m", 1, 1, "a")], [(1, "x"), (2, "y")]),                                        # gold without answer
    ([("m", 1, 1, "a"), ("m", 1, None, "b")], [(1, "x")]),                             # NULL key
    ([("m", 1, 1, "a"), ("m", 1, 2, "b"), ("m", 2, 1, "c")], [(1, "x"), (2, "y")]),      # a run with a gap
    ([("m", 1, 1, "a"), ("m", 1, 1, "b")], [(1, "x")]),                                # answered twice
])
def test_pairing_fails_whatever_is_read(spark, cand, gold):
    _fails_for_every_reader(E.pair_with_gold(spark.createDataFrame(cand, RUN), spark.createDataFrame(gold, GOLD)))


def test_pairing_passes_complete_runs(spark):
    cand = spark.createDataFrame([("m", s, i, "a") for s in (1, 2) for i in (1, 2)], RUN)
    gold = spark.createDataFrame([(1, "x"), (2, "y")], GOLD)
    assert E.pair_with_gold(cand, gold).count() == 4


def test_unpaired_rows_are_reported(spark):
    cand = spark.createDataFrame([(1, "a"), (3, "c"), (None, "d")], "record_id long, candidate string")
    gold = spark.createDataFrame([(1, "x"), (2, "y")], GOLD)
    with pytest.raises(PySparkException):
        E.pair_with_gold(cand, gold).collect()
    sides = {(r.side, r.record_id) for r in E.unpaired_rows(cand, gold).collect()}
    assert sides == {("candidate_only", 3), ("candidate_only", None), ("gold_only", 2)}
    runs = spark.createDataFrame([("m", 1, 1, "a"), ("m", 2, 1, "b"), ("m", 2, 2, "c"), ("n", 1, 9, "z")], RUN)
    got = {tuple(r) for r in E.unpaired_rows(runs, gold, run=["method", "step"]).collect()}
    assert got == {("m", 1, "gold_only", 2), ("n", 1, "gold_only", 1), ("n", 1, "gold_only", 2),
                   ("n", 1, "candidate_only", 9)}


def test_head_records_uses_group_limit(spark):
    df = spark.range(1000).select(F.col("id").alias("record_id"),
                                  (F.col("id") % 3).cast("string").alias("split"))
    h = SR.head_records(df, 5)
    assert h.count() == 15
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_jsonl_export_keeps_null_fields(spark, folder):
    df = spark.createDataFrame([("train", 1, None), ("test", 2, "o")], "split string, record_id long, output string")
    path = os.path.join(folder, "export")
    SR.write_jsonl_splits(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert any('"output":null' in l for l in lines)
    back = SR.reload_splits(spark, path, "record_id long, output string")
    assert {(r.split, r.record_id, r.output) for r in back.collect()} == {("train", 1, None), ("test", 2, "o")}
    # a filter on split prunes folders
    plan = back.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_shared_folder_comes_from_session(spark, folder):
    from notewise.session import checkpoint_base, shared_path
    spark.sparkContext.setCheckpointDir(folder)
    assert checkpoint_base(spark).startswith("file:" + folder) or checkpoint_base(spark).startswith(folder)
    assert shared_path(spark, "x").startswith(checkpoint_base(spark) + "/notewise/")


def test_release_deletes_what_the_application_wrote(spark, folder):
    from notewise.session import cut_lineage, release
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(folder)
    kept = cut_lineage(spark.range(5), spark, "t")
    path = kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)
    if before:
        spark.sparkContext.setCheckpointDir(os.path.dirname(before.removeprefix("file:")))
