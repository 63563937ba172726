"""Size-partitioned MinHash containment search: short items inside long texts.

Items are partitioned by their number of shingles into classes [2^j, 2^(j+1)). The signature
of an item is its k smallest shingle hashes (a bottom-k MinHash sketch), with k set by the
largest size s of its class: k = s - ceil(c * s) + 1 for containment c. A text that holds at
least c of an item's n shingles lacks at most n - ceil(c * n), which is fewer than k, so it
holds one of the signature's hashes: the search loses nothing, for texts of any length. One
pass over a text looks its shingles up among the signatures; candidates are then verified
with the exact shingles.

The items are a stated query set. Tasks build an index for each block of at most
``BLOCK_BYTES`` of their text and write it below the shared folder; the driver sees the names
of these files alone. One pass over the texts reads them: a worker holds ``KEPT_BLOCKS``
indexes at most, and with more blocks takes every batch of texts through all of them. So
nothing is broadcast, and neither memory nor the number of passes grows with the items.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.common import file_system, ids_and_texts, shared_folder, unique_name, worker_value
from ledgerwatch.session import materialise, require_columns

BLOCK_BYTES = 4 << 20
KEPT_BLOCKS = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))

FOUND = "id long, item long, n_shingles long, n_shared long, containment double, first_word long, last_word long"


_words = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case (sharp s as ss), so that case and marks around words don't matter."""
    return _words(text.lower().replace("ß", "ss"))


def shingles_of(words: list, size: int) -> list[tuple]:
    """All shingles in order, repeats included; fewer words than ``size`` are one shingle."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


class Index:
    """Signatures of a block of items, and the words that occur in them."""

    def __init__(self, items: list[tuple[int, str]], size: int, least: float):
        self.size, self.least = size, least
        self.words: dict[str, int] = {}
        by_length, self.items = defaultdict(list), []
        for item, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            shingles = set(shingles_of(words, size))
            if shingles:
                self.items.append((item, shingles))
                by_length[min(size, len(words))].append(len(self.items) - 1)
        # For each shingle length: sorted signature hashes, and the items that have each.
        self.signatures = {}
        for length, members in by_length.items():
            pairs = []
            for m in members:
                grams = np.array(sorted(self.items[m][1]), np.int64)
                hashes = np.sort(self.hashes(grams.T))
                top = 2 ** len(hashes).bit_length() - 1  # largest size of the item's class
                pairs += [(int(h), m) for h in hashes[: top - math.ceil(least * top) + 1]]
            pairs.sort()
            self.signatures[length] = (np.array([h for h, _ in pairs], np.uint64), np.array([m for _, m in pairs], np.int64))

    @staticmethod
    def hashes(columns) -> np.ndarray:
        """A 64-bit hash of each shingle from its word numbers, a column for each place."""
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out + np.asarray(c).astype(np.uint64) + np.uint64(1)) * _MIX[0]
            out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        return out

    def find(self, text: str):
        """``(item, shingles, shared, first word, last word)`` of every item the text contains."""
        get, words = self.words.get, words_of(text)
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for length, (keys, members) in self.signatures.items():
            if len(numbers) < length:
                continue
            places = np.flatnonzero(_runs(numbers > 0, length))  # all words of the shingle are known
            if not len(places):
                continue
            hashes = self.hashes([numbers[places + i] for i in range(length)])
            at = np.searchsorted(keys, hashes)
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == hashes)
            if not hit.any():
                continue
            stop = np.searchsorted(keys, hashes[hit], "right")
            candidates = sorted({int(m) for a, b in set(zip(at[hit].tolist(), stop.tolist())) for m in members[a:b]})
            there = defaultdict(list)
            for p, gram in zip(places.tolist(), zip(*(numbers[places + i].tolist() for i in range(length)))):
                there[gram].append(p)
            for m in candidates:
                item, shingles = self.items[m]
                shared = shingles & there.keys()
                if len(shared) >= math.ceil(self.least * len(shingles) - 1e-9):
                    spots = [p for g in shared for p in there[g]]
                    yield item, len(shingles), len(shared), min(spots), max(spots) + length - 1


def _runs(known: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` known words begin at each place."""
    total = np.concatenate(([0], np.cumsum(known)))
    return total[length:] - total[: len(total) - length] == length


def blocks(items: DataFrame, item_col: str, text_col: str, size: int = 5, least: float = 0.8) -> list[str]:
    """Files of indexes, one for each block of at most ``BLOCK_BYTES`` of text (a longer item alone).

    Repeated items are dropped before the shuffle, tasks take whole blocks, and a file counts
    only if the manifest of the finished tasks names it. Items without a word are in no file.
    """
    spark, limit = items.sparkSession, BLOCK_BYTES
    texts = ids_and_texts(items, item_col, text_col)
    weight = (texts.agg(F.sum(4 * F.length("text").cast("long")).alias("n")).first().n or 0)
    folder = shared_folder(spark, "item-blocks")

    def run(batches):
        names, block, held = [], [], 0

        def write():
            index = Index(block, size, least)
            if index.items:
                name = f"{folder}/{unique_name(len(names), '.index')}"
                system, inner = file_system(name)
                with system.open_output_stream(inner) as out:
                    out.write(pickle.dumps(index.__dict__, pickle.HIGHEST_PROTOCOL))
                names.append(name)

        for batch in batches:
            for item, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "text"))):
                if block and held + len(text) * 4 > limit:
                    write()
                    block, held = [], 0
                block.append((item, text))
                held += len(text) * 4
        if block:
            write()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    dealt = texts.dropDuplicates().repartition(max(1, math.ceil(weight / limit)))  # by bytes alone: no more tasks than blocks
    return sorted(r.file for r in materialise(dealt.mapInArrow(run, "file string"), "item-files").collect())


def _indexes(files: list[str]) -> Iterator[Index]:
    """The indexes in turn; a worker keeps the first few, so with few blocks it reads each file once."""
    kept = worker_value("containment-blocks", dict)
    for name in list(kept.keys() - set(files)):
        del kept[name]
    for name in files:
        index = kept.get(name)
        if index is None:
            system, inner = file_system(name)
            with system.open_input_stream(inner) as stream:
                state = pickle.loads(stream.read())
            index = Index.__new__(Index)
            index.__dict__.update(state)
            if len(kept) < KEPT_BLOCKS - 1 or len(files) <= KEPT_BLOCKS:
                kept[name] = index
        yield index


def contained(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str,
              item_text: str, size: int = 5, least: float = 0.8) -> DataFrame:
    """Every pair of a text and an item of which it holds at least ``least`` of the shingles.

    Words are runs of letters and digits, whatever their case; shingles are ``size`` words and
    count once; an item of fewer words is one shingle. Gives ``id, item,
    n_shingles, n_shared, containment, first_word, last_word`` (positions, from 0, of the
    outermost shared shingles in the text). Null texts are empty; empty items are in no
    text; repeated rows of the texts each give their pairs, repeated items give one; null
    ids and items stay null; other columns are ignored. An empty table on either side gives no
    row; a long text is read whole, in time linear in its words.
    """
    if size < 1 or not 0 < least <= 1:
        raise ValueError("size must be positive and least above 0 and at most 1")
    spark, texts = df.sparkSession, ids_and_texts(df, id_col, text_col)
    files = blocks(items, item_col, item_text, size, least)
    if not files:
        return spark.createDataFrame([], FOUND)

    def run(batches):
        kinds = (pa.int64(),) * 4 + (pa.float64(),) + (pa.int64(),) * 2
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            held = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for index in _indexes(files):
                rows = [(i, item, n, k, k / n, a, b) for i, t in zip(ids, held) for item, n, k, a, b in index.find(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, FOUND)


def clean_rows(df: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str,
               size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose text contains no item, all columns as they are.

    One pass without a shuffle: each task tests its rows and keeps the clean ones. Null and
    empty texts hold no item and stay; repeated rows stay or go alike; without rows or items
    ``df`` comes back as it is; other columns, whatever their names, are not looked at.
    """
    require_columns(df, text_col)
    files = blocks(items, item_col, item_text, size, least)
    if not files:
        return df

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            clean = np.ones(len(texts), bool)
            for index in _indexes(files):
                for at in np.flatnonzero(clean):
                    clean[at] = next(index.find(texts[at] or ""), None) is None
            yield batch.filter(pa.array(clean))

    return df.mapInArrow(run, df.schema)
