"""Stored transaction tables: typed reads, appends, insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwatch.functions.checks import require, require_count
from ledgerwatch.functions.numeric import as_double, unix_timestamp
from ledgerwatch.schemas import RAW_TRANSACTION
from ledgerwatch.session import parts_by_bytes, require_columns

_GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def read_raw(
    spark: SparkSession, path: str, fmt: str = "json", schema: StructType = RAW_TRANSACTION,
    **options: str,
) -> DataFrame:
    """Raw records with a declared schema; nothing is inferred, so no extra pass is made."""
    if fmt not in ("json", "csv", "parquet", "orc"):
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.options(**options).load(path)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """All-text raw records to typed columns; a bad number or time becomes null."""
    require_columns(raw, "hash", "value", "gas", "gas_price", "time_stamp")
    kept = [c for c in ("hash", "from_address", "to_address") if c in raw.columns]
    return raw.select(
        *kept,
        *[as_double(F.col(c)).alias(c) for c in ("value", "gas", "gas_price")],
        unix_timestamp(F.col("time_stamp")).alias("timestamp"),
    )


def append_transactions(
    tx: DataFrame, path: str, grain: str = "day", ts: str = "timestamp",
) -> int:
    """Append to a table partitioned by time; gives the number of rows written.

    ``rebalance`` gathers the rows of a period into few files, and splits a period that
    holds too much for one task.
    """
    part = F.date_format(F.col(ts), _GRAINS[grain])
    written = Observation("append")
    dated = tx.withColumn("period", part).observe(written, F.count(F.lit(1)).alias("rows"))
    dated.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(path)
    return int(written.get["rows"])


def read_transactions(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None,
    grain: str = "day", ts: str = "timestamp",
) -> DataFrame:
    """Read a period back; the partition filter keeps other periods from being opened."""
    tx = spark.read.option("basePath", path).parquet(path)
    tx = tx.withColumn("period", F.col("period").cast("string"))
    if start is not None:
        tx = tx.where((F.col("period") >= start.strftime(_python_format(grain))) & (F.col(ts) >= F.lit(start)))
    if end is not None:
        tx = tx.where((F.col("period") <= end.strftime(_python_format(grain))) & (F.col(ts) <= F.lit(end)))
    return tx


def _python_format(grain: str) -> str:
    return {"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[grain]


def absent_rows(new: DataFrame, stored: DataFrame, key: str = "hash", order: str = "timestamp") -> DataFrame:
    """The rows of a batch whose key is not stored yet, one row per key.

    Within the batch the earliest row wins. ``min`` over a struct combines on the map side,
    so a key that repeats without end costs one row per task.
    """
    rest = [c for c in new.columns if c not in (key, order)]
    first = new.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")
    return first.join(stored.select(key), key, "left_anti").select(*new.columns)


# -- tables bucketed by hash ------------------------------------------------------------------


#: Bytes of input files to a bucket or a file of a stored table. Hashes and addresses take
#: several times the bytes of the keys they are made of.
PART_BYTES = 8 << 20
#: Buckets that one round of inserts fills at most.
ROUND_BUCKETS = 128


def save_bucketed(tx: DataFrame, name: str, path: str, buckets: int, key: str = "hash") -> DataFrame:
    """Store a table in buckets of a key, so that joins on it never shuffle the stored side.

    The files lie below ``path``, in the shared folder or the warehouse; ``open_bucketed`` finds
    them again in another session. A bucket should hold what one task can read at a time;
    ``buckets_for`` says how many that makes.
    """
    require_columns(tx, key)
    require_count("buckets", buckets, 1)
    tx.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return tx.sparkSession.table(name)


def buckets_for(tx: DataFrame, least: int = 8, part_bytes: int = PART_BYTES) -> int:
    """Buckets for a table and all that its input holds: their size stays the same as it grows."""
    return parts_by_bytes(tx, part_bytes, least)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int, key: str = "hash") -> DataFrame:
    """A stored bucketed table by its name; registered anew where this session's catalog lacks it."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) "
                  f"into {buckets} buckets location '{path}'")
    return spark.table(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    """Number of buckets of a table."""
    rows = spark.sql(f"describe extended {name}").where("col_name = 'Num Buckets'").collect()
    require(bool(rows), ValueError, f"{name} is not bucketed")
    return int(rows[0]["data_type"])


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions_of(spark: SparkSession, name: str):
    """Shuffles inside this block make as many partitions as a table has buckets."""
    return _settings(spark, {"spark.sql.shuffle.partitions": str(buckets_of(spark, name))})


def filling(spark: SparkSession, buckets: int):
    """Rows grouped by a table's key and written to its buckets inside this block are shuffled once.

    The files of the shuffles go with the write; otherwise they stay until the driver happens to
    collect its garbage.
    """
    return _settings(spark, {"spark.sql.shuffle.partitions": str(buckets),
                             "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                             "spark.sql.parquet.compression.codec": "zstd"})


def rounds_for(buckets: int) -> int:
    """Rounds of inserts, so that the files of one round's shuffles stay the same size as the table grows."""
    return -(-buckets // ROUND_BUCKETS)


def insert_absent(new: DataFrame, name: str, key: str = "hash", order: str = "timestamp", rounds: int = 1) -> int:
    """Append the rows of a batch whose key a bucketed table lacks, one row per key; their number.

    The batch is shuffled once, to the table's buckets and after a partial aggregate; the stored
    keys are read where they lie. Only the key column of the table is read, from the files that
    it had before; what is appended is written from the join, without a copy.

    A large batch takes several ``rounds``: each reads the whole batch, which must give the same
    rows every time, shuffles the rows of a range of buckets and removes the files of its shuffles.
    A run that ends between two rounds leaves whole buckets; the same batch then adds the rest.
    """
    require_count("rounds", rounds, 1)
    spark, rows, buckets = new.sparkSession, 0, buckets_of(new.sparkSession, name)
    with filling(spark, buckets):
        for k in range(rounds):
            written, stored = Observation(f"insert {k}"), spark.table(name)
            bucket = F.pmod(F.hash(key), F.lit(buckets))
            part = new if rounds == 1 else new.where((bucket >= buckets * k // rounds) & (bucket < buckets * (k + 1) // rounds))
            fresh = absent_rows(part, stored.hint("merge"), key, order).select(*stored.columns)
            fresh.observe(written, F.count(F.lit(1)).alias("rows")).repartition(buckets, key).write.insertInto(name)
            rows += int(written.get["rows"])
    return rows


# -- tables for lookups -----------------------------------------------------------------------

#: Columns that single rows are looked up by.
LOOKUP_COLUMNS = ("hash", "from_address", "to_address")


def write_lookup(
    tx: DataFrame, path: str, grain: str = "day", ts: str = "timestamp", columns: Sequence[str] = LOOKUP_COLUMNS,
    cluster: str = "from_address", distinct: int = 1_000_000, group_bytes: int = 64 << 20, files: int | None = None,
) -> None:
    """Store a table partitioned by time whose lookups by some columns skip most row groups.

    Within a period rows are clustered by ranges of one column (its minima and maxima tell), and
    every row group has a Bloom filter of each lookup column, sized for ``distinct`` values a group.
    ``read_transactions`` reads it; ``lookup.by_hash`` and ``by_address`` need no change, as their
    conditions reach the scan. ``files`` is the least number of parts; more input makes more.
    """
    require_columns(tx, ts, cluster, *columns)
    dated = tx.withColumn("period", F.date_format(F.col(ts), _GRAINS[grain]))
    parts = parts_by_bytes(tx, PART_BYTES, files or 0)
    ranged = dated.repartitionByRange(*([parts] if parts else []), "period", cluster)
    writer = ranged.sortWithinPartitions("period", cluster, *[c for c in columns if c != cluster]).write.mode("append").partitionBy("period")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.option("parquet.block.size", str(group_bytes)).parquet(path)
