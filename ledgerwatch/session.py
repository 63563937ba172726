"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "ledgerwatch", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and no web page."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: a machine-local folder is
    not visible to the executors of a cluster. That folder goes when the process ends; the
    cluster's keeps what results still read, as its own rules say.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="ledgerwatch-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def python_tasks(spark: SparkSession) -> int:
    """Tasks of a stage that works in Python: the configured number of shuffle partitions.

    Adaptive execution goes by bytes and would merge a small input into one task. A local
    session has no use for more than two tasks per core.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(tasks, 2 * context.defaultParallelism) if context.master.startswith("local") else tasks


@contextmanager
def state_partitions(spark: SparkSession):
    """Partitions for the state of a stream that starts inside this block.

    A stream takes the setting over when it starts and keeps it. A local session need not
    keep hundreds of state stores; on a cluster this changes nothing.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(python_tasks(spark)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


#: Bytes that one task of a scan takes at most by default.
SCAN_BYTES = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows evenly over as many tasks as ``python_tasks`` gives, if they come in few files.

    For stages that compute long per row over a small table, such as one file of one row
    group. A table of many files, or of files large enough to be read in many parts, comes
    back as it is, without a shuffle.
    """
    tasks, files = python_tasks(df.sparkSession), df.inputFiles()
    if len(files) >= tasks or file_bytes(df.sparkSession, files) >= tasks * SCAN_BYTES:
        return df
    return df.repartition(tasks, *keys)


def file_bytes(spark: SparkSession, files: list[str]) -> int:
    """Size of some files; of many, from those of every so-manieth."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    some = files[:: 1 + len(files) // 1000]
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in some]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) * len(files) // max(1, len(some))


def parts_by_bytes(df: DataFrame, part_bytes: int, least: int = 1) -> int:
    """Parts to store a result in, so that each comes from about ``part_bytes`` of its input files."""
    return max(least, -(-file_bytes(df.sparkSession, df.inputFiles()) // part_bytes))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` naming the missing columns; needs no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
