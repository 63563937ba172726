"""Byte-level BPE by a hierarchical bitmap over merge ranks.

A pre-token is a linked list of byte ranges. The bucket of a rank holds the list positions
whose pair merges at this rank; a bitmap of two levels (words of 256 ranks, and a word that
marks those in use) tells which buckets hold something, so the next rank is two
find-first-set steps away however long the pre-token is. A position is
stale if its pair has changed since it was put in; stale ones are skipped when they come up.
Work is O(n log n) at most in the bytes of a pre-token.

Texts are cut before each single space that a non-space follows; the split pattern never
matches across such a cut, so a cut piece has the same ids wherever it stands and is kept.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwatch.llm.common import ids_and_texts, text_blocks, worker_value

#: Pieces kept by a worker, and the longest piece that is kept.
KEPT_PIECES = 1_000_000
KEPT_CHARS = 64

_BIT = [1 << i for i in range(256)]

#: Cuts that no match of the split pattern crosses.
cut = re.compile(r" (?=[^\s᠎​﻿])").split


class Ranks:
    """Ranks of byte strings, the pattern that splits texts, and the pieces met so far."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.heads, self.tails, self.tokens = {}, {}, {}
        self._leaf = [0] * (max(self.ranks.values(), default=0) // 256 + 1)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        get, n, bit = ranks.get, len(raw), _BIT
        leaf, top, buckets = self._leaf, 0, {}
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            r = get(raw[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    leaf[w] |= bit[r & 255]
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            word = leaf[w]
            r = (w << 8) + (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                leaf[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                q = get(raw[i : after[k]])
                if q is not None:
                    pair[i] = q
                    if q in buckets:
                        heappush(buckets[q], i)
                    else:
                        buckets[q] = [i]
                        w = q >> 8
                        leaf[w] |= bit[q & 255]
                        top |= 1 << w
            p = before[i]
            if p >= 0:
                q = get(raw[p:k])
                if q is None:
                    pair[p] = -1
                else:
                    pair[p] = q
                    if q in buckets:
                        heappush(buckets[q], p)
                    else:
                        buckets[q] = [p]
                        w = q >> 8
                        leaf[w] |= bit[q & 255]
                        top |= 1 << w
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : after[i]]])
            i = after[i]
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        tokens, out = self.tokens, []
        for t in self.matches(piece):
            ids = tokens.get(t)
            if ids is None:
                found = self.merge(t.encode())
                ids = pack(f"<{len(found)}I", *found)
                if len(t) <= KEPT_CHARS:
                    if len(tokens) >= KEPT_PIECES:
                        tokens.clear()
                    tokens[t] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, *rest = cut(text)
        tails = self.tails
        if len(tails) >= KEPT_PIECES:
            tails.clear()
        extra = {}
        for t in [t for t in set(rest) if t not in tails]:
            (tails if len(t) <= KEPT_CHARS else extra)[t] = self.piece(f" {t}")
        if extra:
            return self.piece(head) + b"".join([tails[t] if t in tails else extra[t] for t in rest])
        return self.piece(head) + b"".join(map(tails.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for; raises ``KeyError`` for an id without a rank."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _maker(spark: SparkSession, path: str, pattern: str):
    """A function that gives a worker its ``Ranks``; the file is read on the driver."""
    sent = spark.sparkContext.broadcast(rank_file(path))
    return lambda: worker_value(f"ranks {path} {pattern}", lambda: Ranks(sent.value, pattern))


def round_trip(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode its ids: ``id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers. Null texts are empty and have no
    ids; a null id stays null; repeated rows each give a row; other columns are ignored.
    ``path`` is a file of lines with a base64 byte string and its rank, all single bytes
    included; ``pattern`` splits texts into pre-tokens, which no merge crosses.
    """
    make = _maker(df.sparkSession, path, pattern)

    def run(batches):
        ranks = make()
        for ids, texts in text_blocks(batches):
            coded = [ranks.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array(coded, pa.binary()), pa.array([ranks.decode(c) for c in coded], pa.binary()),
            ], ["id", "n_tokens", "ids", "decoded"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(
        run, "id long, n_tokens long, ids binary, decoded binary")


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """``id, n_tokens, ids`` of every whole text; see ``round_trip``."""
    return round_trip(df, id_col, text_col, path, pattern).drop("decoded")


def decode(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """``id, text`` from encoded ids; bytes that are not UTF-8 become replacement marks.

    Null ids give an empty text.
    """
    make = _maker(df.sparkSession, path, pattern)

    def run(batches):
        ranks = make()
        for batch in batches:
            texts = [ranks.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    chosen = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return chosen.mapInArrow(run, "id long, text string")
