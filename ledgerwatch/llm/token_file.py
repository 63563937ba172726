"""Token ids in files whose document boundaries are Elias-Fano coded.

A file holds one run of documents in ascending id order: all token ids behind one another in
the fewest whole bytes (2 or 4), the document ids, the boundaries, and a footer with their
sizes. Ids go to the file as they are made; what is kept until its end is an id and a length
for each document. A file ends at ``FILE_IDS`` ids or ``FILE_DOCS`` documents.

The end offset of each document is split into ``low`` bits, stored as they are, and the rest,
stored in unary in a bit vector; every 256th set bit's place is kept as a 32-bit sample, and
``select`` finds any offset from there. That is about two bits a document plus ``low``, and
no table of 64-bit offsets anywhere.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwatch.llm.common import (
    byte_blocks, file_system, ids_and_texts, per_row_task, ragged, range_hashes, shared_folder, unique_name, worker_value,
)
from ledgerwatch.session import file_bytes, materialise

MAGIC = b"EFTOKEN2"
FOOTER = "<QQQQQBBxxxxxx8s"  # documents, ids, bytes of document ids and of low and high bits, id width, low bits, magic
SAMPLE = 256
BLOCK_IDS = 1 << 20
#: Where a file ends and the next one of its task begins, and input bytes of a task.
FILE_IDS, FILE_DOCS, TASK_BYTES = 1 << 28, 1 << 20, 64 << 20
#: Pieces that the library encodes in one call, and pieces and their bytes that a worker keeps.
TOGETHER, KEPT_PIECES, KEPT_BYTES = 4096, 1_000_000, 64 << 20
#: Pieces that make one text for the library.
JOINED = 64


class EliasFano:
    """A non-decreasing sequence of offsets."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, ends: np.ndarray) -> EliasFano:
        n, top = len(ends), int(ends[-1]) if len(ends) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (ends >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits)
        low = np.packbits(((ends[:, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The ``i``-th offset."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - i
        return (high << self.low_bits) | self._low(i, i + 1)[0]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Offsets ``start`` to ``stop`` (exclusive), unpacked together."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first = int(self.samples[start // SAMPLE])
        last = int(self.samples[(stop - 1) // SAMPLE + 1]) if (stop - 1) // SAMPLE + 1 < len(self.samples) else len(self.high) * 8
        places = (first & ~7) + np.flatnonzero(np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little"))
        places = places[places >= first][start % SAMPLE :][: stop - start]
        return ((places - np.arange(start, stop)) << self.low_bits) | self._low(start, stop)

    def _low(self, start: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - start, np.int64)
        a, b = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


class TokenWriter:
    """A file being written; ``close`` adds document ids, boundaries and footer."""

    def __init__(self, system, path: str, width: int):
        self.out, self.width = system.open_output_stream(path), width
        self.known, self.names, self.lengths = [], [], []
        self.n_docs = self.n_ids = 0

    def add(self, doc_ids: list, lengths: np.ndarray, ids: bytes) -> None:
        """Some documents: their ids, the number of token ids of each, and these in ``width`` bytes each."""
        self.known.append(np.array([x is not None for x in doc_ids], bool))
        self.names.append(np.array([0 if x is None else x for x in doc_ids], "<i8"))
        self.lengths.append(np.asarray(lengths, np.int64))
        self.n_docs += len(doc_ids)
        self.n_ids += int(self.lengths[-1].sum())
        self.out.write(ids)

    def full(self) -> bool:
        return self.n_ids >= FILE_IDS or self.n_docs >= FILE_DOCS

    def close(self) -> int:
        """End the file; gives the bytes of its boundaries."""
        known, names, lengths = (np.concatenate(x) for x in (self.known, self.names, self.lengths))
        ef = EliasFano.of(np.cumsum(lengths))
        packed = zlib.compress(np.packbits(known).tobytes() + np.diff(names, prepend=0).astype("<i8").tobytes(), 1)
        for x in (packed, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes()):
            self.out.write(x)
        self.out.write(struct.pack(FOOTER, ef.n, self.n_ids, len(packed), len(ef.low), len(ef.high), self.width, ef.low_bits, MAGIC))
        self.out.close()
        return ef.n_bytes()


def write_file(system, path: str, doc_ids: list, parts: list[bytes], lengths: np.ndarray, width: int) -> int:
    """Write one file; ``parts`` are the ids in ``width`` bytes each, ``lengths`` the ids of each document."""
    out = TokenWriter(system, path, width)
    out.add(doc_ids, lengths, b"".join(parts))
    return out.close()


class TokenFile:
    """A file opened for reading: ``ids(i)`` of any document, or blocks of documents in turn."""

    def __init__(self, system, path: str):
        self.file = system.open_input_file(path)
        foot = self.file.size() - struct.calcsize(FOOTER)
        if foot < 0:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(foot)
        self.n, self.n_ids, a, b, c, self.width, low_bits, magic = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        samples = -(-self.n // SAMPLE)
        if magic != MAGIC or self.n_ids * self.width + a + b + c + 4 * samples != foot:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(self.n_ids * self.width)
        names = zlib.decompress(self.file.read(a))
        known = np.unpackbits(np.frombuffer(names[: (self.n + 7) // 8], np.uint8))[: self.n]
        self.doc_ids = np.cumsum(np.frombuffer(names[(self.n + 7) // 8 :], "<i8"))
        self.known = known.astype(bool)
        low, high = (np.frombuffer(self.file.read(k), np.uint8) for k in (b, c))
        self.ends = EliasFano(self.n, low_bits, low, high, np.frombuffer(self.file.read(4 * samples), "<u4"))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids at the offsets ``start`` to ``stop``."""
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """All ids of the ``i``-th document, the end id included."""
        return self.read(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def blocks(self):
        """``(first document, offsets with the start, ids)`` for runs of about ``BLOCK_IDS`` ids."""
        at, start = 0, 0
        while at < self.n:
            ends = self.ends.range(at, min(self.n, at + 65536))
            keep = max(1, int(np.searchsorted(ends, start + BLOCK_IDS, "right")))
            ends = ends[:keep]
            yield at, np.concatenate(([start], ends)), self.read(start, int(ends[-1]))
            at, start = at + keep, int(ends[-1])


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts in UTF-8 begin: at each text, and at each space that a non-space follows.

    No match of the split pattern crosses such a place. Where the next character is outside
    ASCII and its first two bytes could be those of a space, there is no cut.
    """
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[1:-1], padded[2:]
    space = (data == 32) & ~_BLANK[one]
    for lead, seconds in _SPACE_LEADS:
        odd = np.flatnonzero(space & (one == lead))
        space[odd[np.isin(two[odd], seconds)]] = False
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # a space that ends a text is not cut off
    space[last] = False
    space[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(space)


# White space in ASCII, and the first two bytes of white space and the like outside it.
_BLANK = np.isin(np.arange(256), [0, *range(9, 14), *range(28, 33)])
_SPACE_LEADS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,)))


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.all, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(max(len(self.all), 2 * len(values)), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


class Pieces:
    """Ids of texts from the tokenizers library, which sees each new piece once.

    Pieces are found and told apart by hash in numpy; every piece's bytes are compared with
    those of the kept one, so a collision cannot give wrong ids. Texts that hold the string of
    an added token are encoded whole; with ``added`` false, strings of special tokens are
    ordinary text.
    """

    def __init__(self, vocabulary: bytes, added: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (added or not t.special)]
        self.whole = bool(self.added) and self.tokenizer.normalizer is not None  # added tokens may then look otherwise in a text
        vocabulary_of = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary_of.values()) + 1, np.int64)
        for token, i in vocabulary_of.items():  # a character of a byte-level token stands for a byte
            self.bytes_of[i] = len(token)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.bytes, self.hashes, self.uses = Grown(f"<u{self.width}"), Grown(np.uint8), Grown(np.uint64), Grown(np.int64)
        self.id_at, self.id_n, self.byte_at, self.byte_n = (Grown(np.int64) for _ in range(4))

    def _shrink(self) -> None:
        """Forget the pieces met least, at least half of all."""
        n = len(self.slots)
        uses = self.uses.all[:n]
        keep = np.flatnonzero(uses > max(1, np.median(uses)))
        old = {k: getattr(self, k) for k in ("ids", "bytes", "hashes", "uses", "id_at", "id_n", "byte_at", "byte_n")}
        self.clear()
        for values, at, sizes in (("ids", "id_at", "id_n"), ("bytes", "byte_at", "byte_n")):
            lengths = old[sizes].all[keep]
            getattr(self, values).add(old[values].all[ragged(old[at].all[keep], lengths)])
            getattr(self, at).add(np.cumsum(lengths) - lengths)
            getattr(self, sizes).add(lengths)
        self.uses.add(uses[keep] // 2)
        self.hashes.add(old["hashes"].all[keep])
        self.slots = dict(zip(self.hashes.all[: len(keep)].tolist(), range(len(keep))))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, ``end_id`` behind each, and the number of ids of each."""
        if self.whole:
            return self._plainly(data, offsets, end_id)
        found, at = [], 0
        for k in [*self._with_added(data, offsets), len(offsets) - 1]:
            if at < k:
                found.append(self._by_pieces(data[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at], end_id))
            if k + 1 < len(offsets):
                found.append(self._plainly(data, offsets[k : k + 2], end_id))
            at = k + 1
        if len(found) == 1:
            return found[0]
        return np.concatenate([np.zeros(0, f"<u{self.width}"), *(ids for ids, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Numbers of the texts that hold an added token's string, in order."""
        out, blob = set(), data.tobytes() if self.added else b""
        for token in self.added:
            at = blob.find(token)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                out.add(k)
                at = blob.find(token, int(offsets[k + 1]))
        return sorted(out)

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.full(len(offsets) - 1, end_id, f"<u{self.width}"), np.ones(len(offsets) - 1, np.int64)
        if len(self.slots) >= KEPT_PIECES or self.bytes.n >= KEPT_BYTES:
            self._shrink()
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        unique, first, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        slot = np.array([self.slots.get(h, -1) for h in unique.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            slot[part] = self._add(data, starts[first[part]], ends[first[part]], unique[part])
        self.uses.all[slot] += np.bincount(which, minlength=len(slot))
        slot = slot[which]
        own = ragged(self.byte_at.all[slot], self.byte_n.all[slot])
        sizes = self.byte_n.all[slot]
        if not (np.array_equal(sizes, ends - starts) and np.array_equal(self.bytes.all[own], data)):
            return self._plainly(data, offsets, end_id)  # two pieces with one hash
        lengths = self.id_n.all[slot]
        ids = self.ids.all[ragged(self.id_at.all[slot], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
        return np.insert(ids, upto[1:], end_id), np.diff(upto) + 1

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        n, byte_n = len(self.slots), ends - starts
        raw = data[ragged(starts, byte_n)]
        # Pieces that begin with a space before a plain character may follow one another in one text.
        second = data[np.minimum(starts + 1, len(data) - 1)]
        follows = (byte_n > 1) & (data[starts] == 32) & ~_BLANK[second] & ~np.isin(second, [lead for lead, _ in _SPACE_LEADS])
        run = np.cumsum(~follows)
        place = np.arange(len(run)) - np.searchsorted(run, run)  # within pieces that follow
        first = np.flatnonzero(~follows | (place % JOINED == 0))
        first = first if len(first) and first[0] == 0 else np.concatenate(([0], first))
        stops = np.cumsum(byte_n)
        text_ends = stops[np.append(first[1:], len(stops)) - 1]
        text_starts = np.concatenate(([0], text_ends[:-1]))
        blob = raw.tobytes()
        texts = [blob[a:b].decode() for a, b in zip(text_starts.tolist(), text_ends.tolist())]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), self.ids.all.dtype)
        reached = np.cumsum(self.bytes_of[ids])
        upto = np.searchsorted(reached, stops, "right")  # ids that end within each piece or before
        if not np.array_equal(np.concatenate(([0], reached))[upto], stops):
            raise ValueError("the vocabulary is not byte-level: ids don't add up to the bytes of the pieces")
        id_n = np.diff(upto, prepend=0)
        self.id_at.add(self.ids.n + upto - id_n)
        self.byte_at.add(self.bytes.n + stops - byte_n)
        self.id_n.add(id_n)
        self.byte_n.add(byte_n)
        self.ids.add(ids)
        self.bytes.add(raw)
        self.hashes.add(hashes)
        self.uses.add(np.zeros(len(hashes), np.int64))
        self.slots.update(zip(hashes.tolist(), range(n, n + len(hashes))))
        return np.arange(n, n + len(hashes))

    def _plainly(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found = [[*x.ids, end_id] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], f"<u{self.width}"), np.array([len(f) for f in found], np.int64)


def write(df: DataFrame, id_col: str, text_col: str, vocabulary: str, folder: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Encode every whole text, add ``end_id`` and write files in ascending id order.

    ``vocabulary`` is a file of the tokenizers library with a byte-level pre-tokenizer. Gives
    the manifest, a row per file: ``part, file, name, n_docs, n_ids, bound_bytes``; files follow
    one another by part and file. Null texts are empty and hold the end id alone; null ids come
    first; repeated ids each keep their place (ordered by text), other columns are ignored, and
    an empty table gives no file. Rows of one id (or none) may be dealt over several tasks by how
    their texts begin; a task holds a block of texts, and an id and a length for each document of
    a file. With ``added``, strings of added tokens in a text get their ids, as is the library's
    default; else those of special tokens are ordinary text.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = worker_value(f"pieces {added} {vocabulary}", lambda: Pieces(sent.value, added))
        if end_id >> 8 * pieces.width:
            raise ValueError(f"end_id {end_id} doesn't fit into {pieces.width} bytes")
        system, inner = file_system(folder)
        part, n_files, name, out = TaskContext.get().partitionId(), 0, None, None

        def ended():
            row = {"part": part, "file": n_files, "name": name, "n_docs": out.n_docs, "n_ids": out.n_ids, "bound_bytes": out.close()}
            return pa.RecordBatch.from_pylist([row], kinds)

        for ids, data, offsets in byte_blocks(batches, 2 << 20):
            if not ids:
                continue
            if out is None:
                name = unique_name(part, ".eft")
                out = TokenWriter(system, f"{inner}/{name}", pieces.width)
            coded, sizes = pieces.encode(data, offsets, end_id)
            out.add(ids, sizes, coded.tobytes())
            if out.full():
                yield ended()
                n_files, out = n_files + 1, None
        if out is not None:
            yield ended()

    kinds = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bound_bytes", pa.int64())])
    rows = ids_and_texts(df, id_col, text_col)
    tasks = file_bytes(spark, df.inputFiles()) // TASK_BYTES
    more = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    rows = rows.repartitionByRange(*more, "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    return rows.mapInArrow(run, "part int, file int, name string, n_docs long, n_ids long, bound_bytes long")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``id, start, n_tokens, ids`` (little-endian 32-bit)."""
    return _walk(spark, folder, manifest, "ids binary", lambda x: x.tobytes(), pa.binary())


def checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``id, start, n_tokens, crc`` of its 32-bit ids."""
    return _walk(spark, folder, manifest, "crc long", lambda x: zlib.crc32(x), pa.int64())


def _walk(spark, folder, manifest, column, made, kind) -> DataFrame:
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.file)):  # a row per file
        files.append((r.name, base))
        base += r.n_ids
    if not files:
        return spark.createDataFrame([], f"id long, start long, n_tokens long, {column}")

    def run(row):
        system, inner = file_system(folder)
        f = TokenFile(system, f"{inner}/{row[0]}")
        for at, ends, ids in f.blocks():
            n, off = len(ends) - 1, ends - ends[0]
            yield pa.RecordBatch.from_arrays([
                pa.array(f.doc_ids[at : at + n], pa.int64(), mask=~f.known[at : at + n]), pa.array(row[1] + ends[:-1], pa.int64()),
                pa.array(np.diff(ends), pa.int64()),
                pa.array([made(ids[off[i] : off[i + 1]]) for i in range(n)], kind),
            ], ["id", "start", "n_tokens", column.split()[0]])

    return per_row_task(spark, files, run, f"id long, start long, n_tokens long, {column}")


def round_trip(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Write all texts below the shared folder, ids by the library's defaults, and read the boundaries and checksums back."""
    spark = df.sparkSession
    folder = shared_folder(spark, "tokens")
    manifest = materialise(write(df, id_col, text_col, vocabulary, folder, added=True), "tokens-manifest")
    return checksums(spark, folder, manifest).select(
        F.col("id"), F.col("start"), F.col("n_tokens"), F.col("crc"))
