"""Session helpers: a local session for tests and the shared folder for
materialised tables.

On a cluster the shared folder comes from ``spark.checkpoint.dir``, which the
cluster owner sets to a path every executor can reach. Only a local session
without that setting gets a folder under /tmp (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "notewise") -> SparkSession:
    """Session used by tests and bench: AQE on, UI off, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Scoring stages are CPU-heavy per byte (LCS kernels): let AQE keep a
        # few partitions per core even when a shuffle carries little data.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NOTEWISE_DRIVER_MEM", "16g"))
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="notewise-shared-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_process(spark: SparkSession) -> bool:
    """Do the driver and all tasks share one process, and so one /tmp?"""
    try:
        return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    except Exception:  # Spark Connect has no SparkContext
        return False


def checkpoint_base(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; set one only for a local
    session where it is unset."""
    base = None
    try:
        base = spark.sparkContext.getCheckpointDir()
    except Exception:
        base = None
    if not base:
        try:
            base = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:
            base = None
    if not base:
        try:
            base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        except Exception:
            base = None
    if not base:
        if not _one_process(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="notewise-ckpt-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never reused, so
    an overwrite can never race with a reader of an older run)."""
    return f"{checkpoint_base(spark)}/notewise/{_application(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _application(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return "connect"


def release(spark: SparkSession) -> None:
    """Delete every table that this application wrote below the shared
    folder. For the end of a job: frames read from those tables end with it."""
    path = f"{checkpoint_base(spark)}/notewise/{_application(spark)}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df, spark: SparkSession, name: str, fmt: str = "parquet",
                partition_by: list[str] | None = None):
    """Write ``df`` to the shared folder and read it back.

    Used after nondeterministic steps (generation) and before a frame is
    consumed by several actions: recomputing a lost partition would give
    different answers, a written table does not.
    """
    path = shared_path(spark, name)
    writer = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return spark.read.format(fmt).load(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``notewise`` importable in Python workers (the Arrow UDFs and
    mapInPandas functions live in it): zip the package once per application
    and hand it to Spark, which copies it to every executor."""
    import zipfile

    import notewise
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:
        sc, key = None, id(spark)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(notewise.__file__))
    out_dir = tempfile.mkdtemp(prefix="notewise-pyfiles-")   # driver-side build artifact
    zpath = os.path.join(out_dir, "notewise.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(key)
