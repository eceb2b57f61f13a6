"""Instruction-record sources and sinks.

The native input is a JSON *array* file of objects with the keys
``instruction``, ``input``, ``output`` (extra keys allowed). The plain reader
takes each file whole in one task: right for many bounded files
(``write_record_arrays``). ``array_blocks`` reads large files in blocks by many
tasks. Records are
parsed as Variant, which keeps "key missing" apart from "key is JSON null"
(the typed JSON reader reads both as NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("instruction", "input", "output")

def _vget(v: Column, key: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", typ)


def parse_record_files(spark: SparkSession, path, id_key: str | None = None) -> DataFrame:
    """S1/S3 parsing step: one row per array element, or one row per bad file.

    Columns: source_file, pos, rec (variant, NULL for a bad file), bad_file
    (reason or NULL), record_id. ``record_id`` is the ``id_key`` field when
    given, else a 64-bit hash of the file's name and the position in it.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), "value")
    doc = raw.select("source_file", F.try_parse_json("value").alias("doc"))
    arr = F.expr("try_cast(doc AS array<variant>)")
    doc = doc.withColumn("arr", arr)
    bad = (F.when(F.col("doc").isNull(), F.lit("malformed"))
           .when(F.col("arr").isNull(), F.lit("not_an_array")))
    good = doc.where(bad.isNull()).select("source_file", F.posexplode("arr").alias("pos", "rec"))
    bad_rows = doc.where(bad.isNotNull()).select(
        "source_file", F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("variant").alias("rec"), bad.alias("bad_file"))
    good = good.withColumn("bad_file", F.lit(None).cast("string"))
    out = good.unionByName(bad_rows)
    if id_key:
        return out.withColumn("record_id", _vget(F.col("rec"), id_key, "bigint"))
    place = F.xxhash64("source_file", "pos")
    return out.withColumn("record_id", F.when(F.col("pos").isNotNull(), place))


def validate_records(parsed: DataFrame, clean_scope=("instruction", "input"),
                     mode: str = "quarantine") -> DataFrame:
    """Status of each parsed element.

    reason: missing_key (a required key absent), not_text (a field that is a
    number, boolean, array or object), null_field (JSON null in a field that
    gets cleaned, where the original crashes), not_an_object, malformed /
    not_an_array (whole file). A NULL ``output`` outside the
    cleaning scope is kept. mode='fail' raises on the first bad row instead.
    """
    rec = F.col("rec")
    is_obj = F.schema_of_variant(rec).startswith("OBJECT")
    missing, not_text = F.lit(False), F.lit(False)
    for k in REQUIRED:
        field = F.variant_get(rec, f"$.{k}", "variant")
        missing = missing | field.isNull()
        not_text = not_text | ~F.coalesce(F.schema_of_variant(field), F.lit("VOID")).isin("STRING", "VOID")
    nullf = F.lit(False)
    for k in clean_scope:
        nullf = nullf | F.coalesce(F.is_variant_null(F.variant_get(rec, f"$.{k}", "variant")),
                                   F.lit(False))
    reason = (F.when(F.col("bad_file").isNotNull(), F.col("bad_file"))
              .when(~is_obj, F.lit("not_an_object"))
              .when(missing, F.lit("missing_key"))
              .when(not_text, F.lit("not_text"))
              .when(nullf, F.lit("null_field")))
    out = parsed.withColumn("reason", reason)
    if mode == "fail":
        out = out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(
            F.concat(F.lit("invalid record: "), F.col("reason")))).otherwise(F.col("reason")))
    text = F.col("text") if "text" in parsed.columns else F.lit(None).cast("string")
    return out.select(
        "record_id", "source_file", "pos", "reason",
        *[_vget(rec, k).alias(k) for k in REQUIRED],
        F.when(F.col("rec").isNotNull(), F.to_json(rec)).otherwise(text).alias("raw"))


def read_records(spark: SparkSession, path, id_key: str | None = None,
                 clean_scope=("instruction", "input"), mode: str = "fail", parse=parse_record_files) -> DataFrame:
    """Valid records (record_id, instruction, input, output), the
    fields of ``clean_scope`` cleaned (P1/P2) as part of loading. ``parse``:
    ``array_blocks.parse_record_blocks`` reads large files by many tasks."""
    from notewise.functions.text import clean_scope as _clean
    v = validate_records(parse(spark, path, id_key), clean_scope, mode)
    return _clean(v.where(F.col("reason").isNull()).select("record_id", *REQUIRED), clean_scope)


def read_record_lines(spark: SparkSession, path, id_key: str = "id",
                      clean_scope=("instruction", "input")) -> DataFrame:
    """S1/S3 for JSON lines (the splittable at-scale layout): one record per
    line; an unparsable line becomes a 'malformed' row instead of failing
    the job. Same columns as ``validate_records``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.try_parse_json("value").alias("rec"), F.col("value").alias("_raw"))
    parsed = lines.select(
        "source_file", F.lit(None).cast("int").alias("pos"), "rec",
        F.when(F.col("rec").isNull(), F.lit("malformed")).alias("bad_file"),
        _vget(F.col("rec"), id_key, "bigint").alias("record_id"))
    return validate_records(parsed, clean_scope)


def rejects(spark: SparkSession, path, id_key: str | None = None,
            clean_scope=("instruction", "input"), parse=parse_record_files) -> DataFrame:
    """S2/S3 quarantine: (record_id, raw, reason) of every rejected element."""
    v = validate_records(parse(spark, path, id_key), clean_scope, "quarantine")
    return v.where(F.col("reason").isNotNull()).select("record_id", "raw", "reason")


def write_record_arrays(df: DataFrame, path: str, chunk: int = 2048, chunk_bytes: int = 16 << 20,
                        id_key: str = "id", fields=REQUIRED, by: str | None = None,
                        obj_col: str | None = None) -> None:
    """Write records as JSON array files of at most ``chunk`` records and
    ``chunk_bytes`` characters each (one record may exceed that alone). The id
    goes in as an extra key. ``obj_col``: a column that already holds each
    object's JSON text. ``by``: a folder for each value.

    Each task fills arrays from its own rows in a stream: nothing is
    shuffled or grouped, whatever the ids are, and one array is held at a
    time. Files lie side by side in the folder.
    """
    obj = (F.col(obj_col) if obj_col else
           F.to_json(F.struct(F.col("record_id").alias(id_key), *[F.col(f) for f in fields]),
                     {"ignoreNullFields": "false"}))
    part = F.col(by).cast("string") if by else F.lit("")

    def fill(batches):
        import pyarrow as pa

        def array(key, objs):
            return pa.RecordBatch.from_pydict({"_part": [key], "value": ["[" + ",".join(objs) + "]"]},
                                              schema=pa.schema([("_part", pa.string()), ("value", pa.string())]))

        held: dict = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                objs, size = held.get(key, ([], 0))
                if objs and (len(objs) >= chunk or size + len(text) > chunk_bytes):
                    yield array(key, objs)
                    objs, size = [], 0
                objs.append(text)
                held[key] = (objs, size + len(text))
        for key, (objs, _) in held.items():
            yield array(key, objs)

    arrays = df.select(part.alias("_part"), obj.alias("value")).mapInArrow(fill, "_part string, value string")
    out = arrays.select(F.col("_part").alias(by), "value") if by else arrays.select("value")
    writer = out.write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(by) if by else writer).text(path)


def load_splits(spark: SparkSession, paths: dict[str, str], id_key: str | None = None,
                clean_scope=("instruction", "input", "output")) -> DataFrame:
    """Read one record source per split and stack them."""
    parts = [read_records(spark, p, id_key, clean_scope).withColumn("split", F.lit(s))
             for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_jsonl_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines per split; NULL fields are written as null, not dropped."""
    (df.write.mode("errorifexists").option("ignoreNullFields", "false")
     .partitionBy(by).json(path))


def reload_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a split export back with an explicit schema; the split
    column comes from the folder names (partition discovery, so a filter
    on split prunes whole folders)."""
    return spark.read.schema(schema).json(path)


def head_records(df: DataFrame, n: int = 5, by: str = "split", order: str = "record_id") -> DataFrame:
    """First ``n`` records of each split by id.

    Top-k per group: Spark inserts a per-task group limit before the shuffle,
    so each task sends at most n rows per split.
    """
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def save_outputs(responses: DataFrame, gold: DataFrame, path: str, key: str = "record_id", replace: bool = False) -> None:
    """Store answers next to their gold text, one folder per method and
    step. Every answer is stored; one without gold has a NULL gold text.

    ``replace``: the runs (method, step) of ``responses`` take the place of
    what the folder holds of them, and other runs stay as they are, file by
    file. Spark writes the new runs beside the old ones and swaps each folder
    at the end of the job, so a job that fails leaves every run as it was."""
    writer = (responses.join(gold.select(key, "output"), key, "left").write.partitionBy("method", "step"))
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)
