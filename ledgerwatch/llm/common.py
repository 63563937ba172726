"""Helpers of the training-data operators: inputs, worker caches, files in the shared folder."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerwatch.session import new_path, require_columns

#: White space of the word rule that several operators share.
SPACE = "\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` and ``text`` alone, so that further columns cannot clash; null text is empty."""
    require_columns(df, id_col, text_col)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def worker_value(key: str, make: Callable[[], object]):
    """A value that a Python worker process makes once and keeps for its later tasks.

    Workers outlive an operator, so a worker holds one value at a time: what the operator
    before kept is let go when the next one asks for its own. This package travels to the
    workers by value, so its own module variables start anew with each task.
    """
    kept = sys.modules.setdefault("_ledgerwatch_worker", types.SimpleNamespace()).__dict__
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in blocks of about ``limit`` bytes; a longer text is a block of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("id"))
        rows, n = max(1, batch.num_rows), batch.num_rows
        step = max(1, min(n, limit * rows // max(1, texts.nbytes)))
        for at in range(0, n, step):
            yield ids.slice(at, step).to_pylist(), texts.slice(at, step).to_pylist()


_ODD = 0x9E3779B97F4A7C15


def powers(n: int, base: int) -> np.ndarray:
    """Powers 0 to n-1 of an odd base, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each range of some bytes; ranges are in order and don't overlap.

    Sums of bytes times powers, taken back to the range's start, and mixed. Works on ``chunk``
    bytes at a time (on a longer range at once).
    """
    out = np.zeros(len(starts), np.uint64)
    up = down = powers(0, _ODD)
    at = 0
    while at < len(starts):  # as many whole ranges as fit
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        base, size = starts[at], int(ends[to - 1] - starts[at])
        if size > len(up):
            up, down = powers(size + 1, _ODD), powers(size + 1, pow(_ODD, -1, 1 << 64))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base]
        at = to
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of several ranges, one behind the other."""
    return np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def send(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast a bounded value with the code of its class; the result gives it back in a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    mark = uuid.uuid4().hex

    def get():
        kept = worker_value("sent", dict)
        if mark not in kept:
            if len(kept) > 3:
                kept.clear()
            kept[mark] = pickle.loads(sent.value)
        return kept[mark]

    return get


def byte_blocks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, UTF-8 bytes and offsets of texts, without a Python string; blocks as ``text_blocks`` makes them."""
    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text"))
        texts, n = texts.cast(pa.large_string()), batch.num_rows
        step = max(1, min(n, limit * max(1, n) // max(1, texts.nbytes)))
        for at in range(0, n, step):
            part = texts.slice(at, step)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            yield ids.slice(at, step).to_pylist(), data, offsets - offsets[0]


def file_system(uri: str):
    """The file system of a folder and the folder's path in it, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    path = new_path(spark, label)
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    return path


def unique_name(part: int, suffix: str) -> str:
    """A file name that no other attempt of the same task uses.

    A file counts only if the rows its task returned name it; what failed attempts leave is
    never read.
    """
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def per_row_task(spark: SparkSession, rows: list, fn: Callable, schema: str) -> DataFrame:
    """``fn(row)`` for each row, each in a task of its own; rows are metadata such as file names."""
    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from fn(rows[i])

    return spark.range(0, len(rows), 1, max(1, len(rows))).mapInArrow(run, schema)
