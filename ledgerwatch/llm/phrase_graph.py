"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are three words in a row, edges are four: the longest grams that are counted. An edge runs
from its first three words to its last three. A text gives one gram per word, the four words
from there on, or fewer at the end of a piece. So the count of a node is the sum of its outgoing
edges and of the pieces that end in it, the count of two words is the sum of the nodes that begin
with them and of the pieces that end there, and so on down: shorter grams are never counted in
the text.

Grams travel packed: each task sums the grams of a few megabytes of text and sends, for each
bucket of nodes, one sorted and compressed table. A bucket is added up on its own; its sums by
the first two words go on, packed likewise, and those by the first word after them. A frequent
word or pair is thus in all buckets of the level below and is added up in each of them first.

Frequent edges that follow one another through nodes without any other use are then compacted
to paths: passages of any length that occur as a whole. All edges of a path have its count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerwatch.llm.common import ragged, range_hashes, text_of
from ledgerwatch.session import file_bytes, materialise, python_tasks, require_columns

#: Words of an edge.
EDGE = 4
#: Bytes of text that a task sums at a time, rows that a bucket gathers before it adds them up.
TEXT_BYTES, ROWS = 2 << 20, 1 << 20
#: Level of compression.
LEVEL = 5
#: Bytes of input files for each task that adds up, and buckets for each of those; only one is in memory at a time.
TASK_BYTES, BUCKETS = 16 << 20, 6
#: Tasks at most; beyond, a task has more buckets.
MOST_TASKS = 20_000
#: Rows (texts or packed tables) that pass to Python at a time.
BATCH = 256
#: Ways of a word or a pair in the joins of parts.
SALTS = 16

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_PACKED = "lang string, bucket long, size long, grams binary"
_COUNTED = "lang string, size long, phrase string, f long, bucket long, grams binary"


def _cuts(data: bytes, limit: int) -> Iterator[tuple[bytes, bool]]:
    """A text (already in lower case, pieces ended by full stops) in parts of about ``limit`` bytes.

    Cut between pieces. A piece above the limit is cut between words; such a part is open: it
    counts full edges only, and its last three words come again in the next part.
    """
    at = 0
    while len(data) - at > limit:
        to, is_open = data.rfind(b".", at, at + limit) + 1, False
        if to <= at:
            stop, space = data.find(b".", at + limit), data.find(b" ", at + limit)
            is_open = space >= 0 and not 0 <= stop < space
            to = space if is_open else stop + 1 if stop >= 0 else len(data)
        part = data[at:to]
        if is_open:
            before, *last = part.rsplit(None, EDGE - 1)
            if len(last) < EDGE - 1:  # not even one edge: read on
                limit *= 2
                continue
            at += len(before) + len(part[len(before):]) - len(part[len(before):].lstrip())
        else:
            at = to
        yield part, is_open
    yield data[at:], False


def grams_of(parts: list[tuple[bytes, bool]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct grams of texts and their counts: at each word the edge, or what is left of the piece.

    Grams are told apart by their words' numbers, not by a hash.
    """
    words = []
    for data, is_open in parts:
        words += data.replace(b".", b" . ").split()
        words.append(b"" if is_open else b".")
    names = sorted(set(words) - {b".", b""})
    number = {w: k + 2 for k, w in enumerate(names)} | {b".": 0, b"": 1}
    a = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    del words, number
    size = len(names) + 2
    padded = np.concatenate((a, np.zeros(EDGE, np.int32)))
    cells, ended, cut = [], np.zeros(len(a), bool), np.zeros(len(a), bool)
    for k in range(EDGE):  # words after the end of the piece are none (0)
        cell = padded[k : k + len(a)]
        cut |= ~ended & (cell == 1)
        ended |= cell < 2
        cells.append(np.where(ended, 0, cell))
    keep = (cells[0] > 0) & ~cut
    first, second = (cells[i][keep].astype(np.int64) * size + cells[i + 1][keep] for i in (0, 2))
    del cells, ended, cut, padded
    pairs, place = np.unique(np.concatenate((first, second)), return_inverse=True)
    half = len(first)
    del first, second
    keys, counts = np.unique(place[:half] * len(pairs) + place[half:], return_counts=True)
    del place
    columns = [x for p in (pairs[keys // max(1, len(pairs))], pairs[keys % max(1, len(pairs))]) for x in (p // size, p % size)]
    texts = pa.array([None, None, *names], pa.binary())
    joined = pc.binary_join_element_wise(*(texts.take(pa.array(c)) for c in columns), pa.scalar(b" "), null_handling="skip")
    return joined, counts.astype(np.int64)


def _buffers(grams: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array that is not a slice."""
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[: len(grams) + 1]
    return np.frombuffer(grams.buffers()[2] or b"", np.uint8), offsets.astype(np.int64)


def _ends(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first ``size`` words of each gram end, and the number of its words."""
    spaces = np.flatnonzero(data == 32)
    first = np.searchsorted(spaces, offsets)
    words = np.diff(first) + 1
    longer = words > size
    ends = offsets[1:].copy()
    ends[longer] = spaces[first[:-1][longer] + size - 1]
    return ends, words


def first_words(grams: pa.Array, size: int) -> pa.Array:
    """Each gram's first ``size`` words."""
    data, offsets = _buffers(grams)
    ends, _ = _ends(data, offsets, size)
    lengths = ends - offsets[:-1]
    kept = data[ragged(offsets[:-1], lengths)]
    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(starts), pa.py_buffer(kept)])


def summed(grams: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct grams and the sums of their counts."""
    found = pa.table({"g": grams, "n": counts}).group_by("g").aggregate([("n", "sum")]).combine_chunks()
    names, sums = (found[c].chunk(0) if found[c].num_chunks else pa.array([], k) for c, k in (("g", pa.binary()), ("n_sum", pa.int64())))
    return names, sums.to_numpy()


def packed(lang: str, grams: pa.Array, counts: np.ndarray, size: int, buckets: int) -> Iterator[tuple]:
    """``lang, bucket, size, grams`` rows: for each bucket of first words, its grams as a compressed table."""
    if not len(grams):
        return
    data, offsets = _buffers(grams)
    ends, _ = _ends(data, offsets, size)
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    bucket = (range_hashes(data, offsets[:-1], ends) ^ seed) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    stops = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    data, offsets = _buffers(grams.take(pa.array(order)))
    counts, lengths, coder = counts[order], np.diff(offsets), zstandard.ZstdCompressor(level=LEVEL)
    for b in np.flatnonzero(np.diff(stops)):
        i, j = stops[b], stops[b + 1]
        yield lang, int(b), int(j - i), coder.compress(_planes(lengths[i:j], 4) + _planes(counts[i:j], 8) + data[offsets[i] : offsets[j]].tobytes())


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the higher ones are zeros in a row."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(blob: bytes, n: int) -> tuple[pa.Array, np.ndarray]:
    """Grams and counts of a packed table of ``n`` rows."""
    data = zstandard.ZstdDecompressor().decompress(blob)

    def numbers(at, width):
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)

    offsets = np.concatenate(([0], np.cumsum(numbers(0, 4)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[12 * n :])]), numbers(4 * n, 8)


def _rows(rows: Iterator[tuple], schema: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``limit`` bytes."""
    names, held, got = [c.split()[0] for c in schema.split(", ")], 0, []
    for row in rows:
        got.append(row)
        held += 100 + len(row[-1] or b"")
        if held > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*got))], names)
            held, got = 0, []
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*got))], names)


_KINDS = {"lang": pa.string(), "bucket": pa.int64(), "size": pa.int64(), "grams": pa.binary(), "phrase": pa.string(), "f": pa.int64()}


def _text_grams(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed grams of all texts."""
    def run(batches):
        def made():
            texts, held = defaultdict(list), defaultdict(int)

            def flushed(lang):
                grams, counts = grams_of(texts.pop(lang))
                held.pop(lang)
                yield from packed(lang, grams, counts, EDGE - 1, buckets)

            for batch in batches:
                for lang, text in zip(*(batch.column(k) for k in (0, 1))):
                    lang, data = lang.as_py(), text.as_buffer().to_pybytes().translate(_TABLE) if text.is_valid else b""
                    for part, is_open in _cuts(data, TEXT_BYTES):
                        texts[lang].append((part, is_open))
                        held[lang] += len(part) + 50
                        if held[lang] >= TEXT_BYTES:
                            yield from flushed(lang)
                while sum(held.values()) > 4 * TEXT_BYTES:
                    yield from flushed(max(held, key=held.get))
            for lang in list(held):
                yield from flushed(lang)

        yield from _rows(made(), _PACKED)

    return rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, _PACKED)


def _counted(grams: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """One level: adds up packed grams bucket by bucket. Stored rows hold either a phrase that occurs
    ``least`` times or more with its count ``f``, or packed sums by the first ``size - 1`` words (``size`` is then their number).

    The last level (size 1) also gives each language's number of words, as a phrase of size 0.
    """
    tasks = max(1, min(MOST_TASKS, buckets // BUCKETS))

    def run(batches):
        def frequent(lang, names, counts, only=None):
            at = counts >= least
            if only is not None:
                at &= only
            at = np.flatnonzero(at)
            _, words = _ends(*_buffers(names), EDGE)
            for g, n, w in zip(names.take(pa.array(at)).to_pylist(), counts[at].tolist(), words[at].tolist()):
                yield lang, w, g.decode(), n, None, None

        def closed(parts):
            for lang, tables in parts.items():
                names, counts = _added(tables)
                if size == EDGE - 1:
                    _, words = _ends(*_buffers(names), EDGE)
                    yield from frequent(lang, names, counts, words == EDGE)
                    names, counts = summed(first_words(names, size), counts)
                _, words = _ends(*_buffers(names), EDGE)
                yield from frequent(lang, names, counts, words == size)
                if size == 1:
                    yield lang, 0, "", int(counts.sum()), None, None
                else:
                    onward = summed(first_words(names, size - 1), counts)
                    for lang, bucket, n, blob in packed(lang, *onward, size - 1, buckets):
                        yield lang, n, None, None, bucket, blob

        def made():
            parts, now, held = defaultdict(list), None, defaultdict(int)
            for batch in batches:
                for lang, bucket, n, blob in ([x.as_py() for x in row] for row in zip(*batch.columns)):
                    if bucket != now and parts:
                        yield from closed(parts)
                        parts, held = defaultdict(list), defaultdict(int)
                    now = bucket
                    parts[lang].append(unpacked(blob, n))
                    held[lang] += n
                    if held[lang] > ROWS and len(parts[lang]) > 1:
                        parts[lang], held[lang] = [_added(parts[lang])], 0
            yield from closed(parts)

        yield from _rows(made(), _COUNTED)

    dealt = grams.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    with _small_batches(grams.sparkSession):
        return materialise(dealt.mapInArrow(run, _COUNTED), f"phrases-{size}")


@contextmanager
def _small_batches(spark: SparkSession):
    """Few rows at a time between the JVM and Python inside this block: a packed row is large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _added(tables: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    names, counts = zip(*tables)
    return summed(pa.concat_arrays(names), np.concatenate(counts))


def counts(df: DataFrame, text_col: str, lang_col: str | None = None, least: int = 30) -> DataFrame:
    """``lang, size, phrase, f``: all phrases of one to four words that occur ``least`` times or more
    within pieces, with their counts, and each language's number of words as a row of size 0.

    A-Z are lower-cased; pieces lie between ``. , ; : ! ?`` and line ends, words between
    spaces and tabs; null languages are ``und``; null and empty texts have no words; texts and
    pieces may be of any length; repeated rows count each time.
    """
    require_columns(df, text_col, *([lang_col] if lang_col else []))
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")) if lang_col else F.lit("und")
    rows = df.select(lang.alias("lang"), text_of(text_col).alias("text"))
    buckets = BUCKETS * max(python_tasks(df.sparkSession), file_bytes(df.sparkSession, df.inputFiles()) // TASK_BYTES)
    grams, levels = _text_grams(rows, buckets), []
    for size in range(EDGE - 1, 0, -1):
        level = _counted(grams, size, least, buckets)
        levels.append(level.where("phrase is not null").select("lang", "size", "phrase", "f"))
        grams = level.where("grams is not null").select("lang", "bucket", "size", "grams")
    found = levels[0].union(levels[1]).union(levels[2])
    total = found.where("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return found.where("size > 0").union(total)


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides. Spark takes a stored table for as large as its compressed files
    and an explode for no larger than its input, so it would broadcast tables many times its bound.
    """
    return left.join(right.hint("merge"), on, how)


def _head(words: str, n: int):
    return F.substring_index(words, " ", n)


def paths(counted: DataFrame) -> DataFrame:
    """``lang, words, f``: the frequent edges of the graph, compacted to paths without branches.

    An edge is followed by another if all three, the edges and the node between them, have one
    count: then every occurrence of the node comes from the one and goes on to the other, and
    no piece ends there. Each edge points to its predecessor; the pointers are doubled until
    all reach their path's first edge. ``words`` is the path's text.

    A path is as long as a passage that occurs often; no path is a ring, as pieces end.
    """
    edges = counted.where(f"size = {EDGE}").select("lang", "phrase", "f")
    nodes = counted.where(f"size = {EDGE - 1}").select("lang", F.col("phrase").alias("node"), "f")
    ends = edges.select("lang", "f", F.col("phrase").alias("from"), _head("phrase", -(EDGE - 1)).alias("node"))
    begins = edges.select("lang", "f", F.col("phrase").alias("to"), _head("phrase", EDGE - 1).alias("node"))
    links = _merged(_merged(ends, nodes, ["lang", "node", "f"]), begins, ["lang", "node", "f"]).select(
        "lang", F.col("to").alias("phrase"), F.col("from").alias("head"))
    at = _merged(edges, links, ["lang", "phrase"], "left").select(
        "lang", "phrase", "f", F.coalesce("head", "phrase").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    at = materialise(at, "phrase-paths")
    while True:
        above = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        at = materialise(_merged(at, above, ["lang", "head"]).select(
            "lang", "phrase", "f", F.col("_head").alias("head"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("_steps") > 0).alias("moved")), "phrase-paths")
        if at.where("moved").isEmpty():
            break
    last = F.substring_index("phrase", " ", -1)
    listed = F.array_sort(F.collect_list(F.struct("steps", last.alias("w"))))
    return at.groupBy("lang", "head", "f").agg(listed.alias("l")).select(
        "lang", F.concat_ws(" ", _head("head", EDGE - 1), F.transform("l", lambda x: x["w"])).alias("words"), "f")


def collocations(df: DataFrame, text_col: str, lang_col: str | None = None, least: int = 30,
                 top: int = 2000, covered: int = 80) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two to four words that occur ``least`` times or more. Cut after
    any of its words, a candidate scores floor(2000000 a / (l + r)) with the counts of both
    parts; the lowest cut counts, the first of equal ones. A candidate is dropped if it lies
    within a longer one that has at least ``covered`` percent of its count. Ranks go by falling
    score and count, then by the phrase's bytes. ``n`` is the language's number of words.

    Nulls, empty and very long texts, repeated rows: see ``counts``. Ties have one order. Other
    columns are ignored; an empty table gives no rows.
    """
    counted = materialise(counts(df, text_col, lang_col, least), "phrases")
    long_ones = paths(counted)
    words = F.split("words", " ")
    windows = long_ones.withColumn("w", words).select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - (EDGE - 1)), lambda i: F.array_join(F.slice("w", i, EDGE), " "))).alias("phrase"))
    shorter = counted.where(f"size between 2 and {EDGE - 1}").select("lang", "f", "phrase")
    candidates = windows.unionByName(shorter).withColumnsRenamed({"f": "a"}).withColumn("size", F.size(F.split("phrase", " ")))
    # What lies in a longer candidate lies in one that is longer by a word and as frequent at least.
    within = candidates.where("size > 2").select("lang", F.col("a").alias("_f"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    longest = within.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    candidates = _merged(candidates, longest, ["lang", "phrase"], "left").where(
        f"_f is null or 100 * cast(_f as decimal(20, 0)) < {covered} * cast(a as decimal(20, 0))").drop("_f")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    # A word may be part of very many candidates: parts of one and two words come in several copies.
    parts = counted.where(f"size between 1 and {EDGE - 1}").withColumn(
        "salt", F.explode(F.expr(f"sequence(0, if(size < 3, {SALTS - 1}, 0))"))).select("lang", F.col("phrase").alias("part"), "f", "salt")
    some = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")

    def with_part(rows, part, n, name):
        salted = rows.withColumn("salt", F.when(F.expr(n) < 3, some).otherwise(0))
        return _merged(salted, parts.withColumnsRenamed({"part": part, "f": name}), ["lang", part, "salt"]).drop("salt")

    cuts = with_part(with_part(cuts, "left", "k", "l"), "right", "size - k", "r")
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select(
        "lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return _merged(first, totals, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
