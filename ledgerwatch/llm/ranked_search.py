"""Ranked lexical search by dense blocked matrix products.

The items are a stated query set. They go out in blocks of at most ``BLOCK_BYTES`` of text, each
block against all documents. The documents are read once a block: what they hold of the
block's vocabulary (term numbers and counts) is stored, and the document frequencies come from
there. Then items and documents meet in tiles. A tile of items has a compact vocabulary: only
the terms of these items have columns. The weights of the items' terms (terms times items) and
the impacts of the documents' terms (documents times terms) are dense float64 matrices, and one
BLAS product gives the scores of all pairs of the tile.

All numbers are integers. The vocabulary is cut into tiles whose partial sums stay below 2^53, so
float64 holds each exactly, whatever the order of the additions; partial scores are added as
64-bit integers. An entry too large for one tile is spread over several.

Each tile keeps, for each item, the documents at or above the k-th best score so far, equal ones
included, and then the first k by (score, id); so ties don't depend on the tiling.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerwatch.llm.common import byte_blocks, ids_and_texts, send
from ledgerwatch.session import materialise

BLOCK_BYTES = 4 << 20
#: Items, documents and terms of a tile at most: 8 MB an item matrix, 16 MB a document matrix.
ITEMS, DOCS, TERMS = 256, 512, 4096
#: Below this, float64 holds every integer.
EXACT = 1 << 53
#: An impact is below this: 10^9 tf div (1000 tf + 8 m) with m above 0.
IMPACT = 1_000_000
#: Rows of one item go through this many tasks before they meet.
SALTS = 64

_CHUNK = 4 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Runs of letters, digits and all characters beyond ASCII, as UTF-8; only A-Z lower-cased."""
    return data.translate(_TABLE).split()


def _chunks(data: bytes) -> Iterator[bytes]:
    """A text in parts of about ``_CHUNK`` bytes, cut between terms."""
    if len(data) <= _CHUNK:
        yield data
        return
    data, at = data.translate(_TABLE), 0
    while at < len(data):
        to = data.find(b" ", at + _CHUNK)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


class Vocabulary:
    """Terms of a block of items, numbered, and the items as lists of (term number, occurrences)."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items = []
        for item, text in items:
            counts = Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(text.encode()))
            if counts:
                self.items.append((item, sorted(counts.items())))

    def held(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Terms of a text with repeats, the vocabulary's terms in it in order, and their occurrences."""
        n, parts, get = 0, [], self.numbers.get
        for chunk in _chunks(data):
            terms = terms_of(chunk)
            n += len(terms)
            known = np.fromiter((k for k in map(get, terms) if k is not None), np.int32)
            parts.append(np.unique(known, return_counts=True))
        if len(parts) == 1:
            return n, parts[0][0], parts[0][1].astype(np.int64)
        total = np.zeros(len(self.numbers), np.int64)
        for terms, counts in parts:
            total[terms] += counts
        terms = np.flatnonzero(total).astype(np.int32)
        return n, terms, total[terms]


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def vocabulary_tiles(entries: np.ndarray, terms: int = 0, limit: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cut a matrix of integer weights (terms times items) into ``(rows, weights)`` whose column sums
    stay at ``limit`` or below, so that products with impacts below ``IMPACT`` stay exact.

    A weight above the limit is split: its row comes again in later tiles.
    """
    terms, limit = terms or TERMS, limit or (EXACT - 1) // IMPACT
    tiles, rows, parts, held = [], [], [], np.zeros(entries.shape[1], np.int64)

    def close():
        nonlocal rows, parts, held
        if rows:
            tiles.append((np.array(rows), np.array(parts, np.float64)))
        rows, parts, held = [], [], np.zeros(entries.shape[1], np.int64)

    for row, left in enumerate(entries):
        while left.any():
            part = np.minimum(left, limit - held)
            if len(rows) == terms or ((part < left).any() and rows):
                close()
                continue
            rows.append(row)
            parts.append(part)
            held, left = held + part, left - part
    close()
    return tiles


class Searcher:
    """A block's item tiles with the weights of their terms; scores stored documents tile by tile."""

    def __init__(self, vocabulary: Vocabulary, documents: int, total: int, frequency: dict[int, int]):
        self.documents, self.total, self.n_terms = documents, total, len(vocabulary.numbers)
        self.items = [i for i, _ in vocabulary.items]
        weights = {t: weight(documents, f) for t, f in frequency.items()}
        self.counts = [[(t, q * weights[t]) for t, q in counts if weights.get(t)] for _, counts in vocabulary.items]

    def tiles(self):
        """First item, last item, the compact vocabulary and its tiles; made anew, as they are larger than the items."""
        for first in range(0, len(self.items), ITEMS):
            part = self.counts[first : first + ITEMS]
            words = np.unique(np.array([t for counts in part for t, _ in counts], np.int64))
            entries = np.zeros((len(words), len(part)), np.int64)
            for column, counts in enumerate(part):
                if counts:
                    numbers, values = zip(*counts)
                    entries[np.searchsorted(words, numbers), column] = values
            yield first, first + len(part), words, vocabulary_tiles(entries)

    def scores(self, place: np.ndarray, terms: np.ndarray, impacts: np.ndarray, docs: int, words: np.ndarray, tiles) -> np.ndarray:
        """Scores (documents times items) from the documents' impacts, given as triples."""
        column = np.full(self.n_terms, -1, np.int64)
        out = None
        for rows, weights in tiles:
            column[words] = -1
            column[words[rows]] = np.arange(len(rows))
            at = column[terms]
            dense = np.zeros((docs, len(rows)))
            dense[place[at >= 0], at[at >= 0]] = impacts[at >= 0]
            part = (dense @ weights).astype(np.int64)
            out = part if out is None else out + part
        return out

    def impacts(self, place: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The impact of each occurrence count, given the document's place and the documents' lengths."""
        m = 100 - 75 + np.array([75 * int(n) * self.documents // self.total for n in lengths], np.int64)
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m[place])


class Best:
    """The first k documents of each item by falling score, then rising id (none last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items
        self.floor = np.ones(items, np.int64)  # a score must be above 0

    def add(self, first: int, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        """Scores of a tile, documents times items from ``first`` on."""
        kept = scores >= self.floor[first : first + scores.shape[1]]
        for c in np.flatnonzero(kept.any(axis=0)):
            rows, item = np.flatnonzero(kept[:, c]), first + c
            old = self.found[item]
            s, i, m = (np.concatenate(p) for p in zip(old, (scores[rows, c], ids[rows], missing[rows])))
            order = np.lexsort((i, m, -s))[: self.k]
            self.found[item] = (s[order], i[order], m[order])
            if len(order) == self.k:
                self.floor[item] = s[order[-1]]


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct items in blocks of at most ``BLOCK_BYTES`` of text (a longer item alone), read one by one."""
    block, held = [], 0
    for r in ids_and_texts(items, item_col, text_col).dropDuplicates().orderBy("id", "text").toLocalIterator():
        if block and held + len(r.text) * 4 > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r.id, r.text))
        held += len(r.text) * 4
    if block:
        yield block


def held_terms(df: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``id, n, terms, counts`` of every text with a term: its length and what it holds of a vocabulary."""
    sent = send(df.sparkSession, vocabulary)

    def run(batches):
        words = sent()
        for ids, data, offsets in byte_blocks(batches):
            data, rows = data.tobytes(), []
            for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                n, terms, counts = words.held(data[a:b])
                if n:
                    rows.append((i, n, terms, counts))
            if rows:
                at = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[k] for r in rows]), kind))
                         for k, kind in ((2, pa.int32()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def _numbers(lists: pa.ListArray) -> np.ndarray:
    """All entries of the lists of a batch, one behind the other."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def frequencies(stored: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each term of the vocabulary: counted in each task, then added up; one number a term."""
    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0)), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "df"])

    counted = stored.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.toLocalIterator()}


def search(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item, rank, id, score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, in whole
    texts; only A-Z are lower-cased. N counts the documents with a term, L all their terms, n one
    document's, df the documents holding a term, tf its occurrences in one. A term's weight w is
    floor(1000 ln((2N + 2) / (2df + 1))); with m = 25 + (75 n N div L) a document's score sums
    w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included. Only scores above 0
    count; equal ones stand by rising id, null ids last.

    Null and empty texts have no terms and are in no result; very long ones are read in parts.
    Repeated rows of the texts are documents of their own, a repeated item (id and text) is one,
    an id with two texts is two items under one id; null items stay null; other columns are
    ignored; an empty table on either side gives no rows. Memory: a tile of each matrix, a
    block's items, and k documents for each item of a block.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark, out = df.sparkSession, None
    for block in blocks(items, item_col, item_text):
        vocabulary = Vocabulary(block)
        stored = materialise(held_terms(df, id_col, text_col, vocabulary), "search-terms")
        whole = stored.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        if not whole["documents"] or not vocabulary.items:
            continue
        part = _best(stored, Searcher(vocabulary, whole["documents"], whole["total"], frequencies(stored, len(vocabulary.numbers))), k)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item long, rank int, id long, score long") if out is None else out


def _best(stored: DataFrame, searcher: Searcher, k: int) -> DataFrame:
    sent = send(stored.sparkSession, searcher)

    def run(batches):
        block = sent()
        best, tiles = Best(len(block.items), k), list(block.tiles()) if len(block.items) <= ITEMS else None
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                ids, lengths = part.column(0), part.column(1).to_numpy()
                sizes = part.column(2).value_lengths().to_numpy()
                place, terms = np.repeat(np.arange(len(sizes)), sizes), _numbers(part.column(2))
                impacts = block.impacts(place, _numbers(part.column(3)), lengths).astype(np.float64)
                numbers, missing = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for first, _, words, pieces in tiles or block.tiles():
                    if pieces:
                        best.add(first, numbers, missing, block.scores(place, terms, impacts, len(sizes), words, pieces))
        rows = [(n, block.items[n], None if m else int(i), int(s)) for n, found in enumerate(best.found) for s, i, m in zip(*found)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["no", "item", "id", "score"])

    found = stored.mapInArrow(run, "no long, item long, id long, score long")
    order = (F.desc("score"), F.col("id").asc_nulls_last())
    salted = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    near = salted.withColumn("_at", F.row_number().over(Window.partitionBy("no", "_salt").orderBy(*order))).where(F.col("_at") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "id", "score")
