"""SimHash fingerprints and all links within a few bits, by pigeonring filtering.

The 64 bits are cut into ``max_bits + 1`` consecutive segments, thought of as a ring. If two
fingerprints differ in at most t bits over m segments, some start exists from which every
chain of l segments differs in at most floor(l * t / m) bits. Candidates are found by the
first two steps of the chain at once: the first segment equal and, within the second step's
budget, at most one bit in the next. The key of a start is both segments; each fingerprint is
stored under its own key and asks under the keys with one bit of the second segment turned.
All 64 bits are then compared inside a key (with two bits, three segments, that is the only
longer chain). A key with more than ``MOST_TOGETHER`` rows is cut further: the bits in which its
rows differ are dealt into ``max_bits + 1`` segments, of which one must be equal, and so on.

Equal fingerprints are one node, so copies cost nothing. Inside a key only as many links
leave as join its members, never all pairs. Components come from label spreading with
pointer jumping over these links; every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.llm.common import ids_and_texts, text_blocks
from ledgerwatch.session import materialise

BITS = 64
SEED = 42
BLOCK = 1 << 15
MOST_TOGETHER = 1 << 12


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of UTF-8 bytes: words lower-cased in A-Z, a bit set if over half the shingles set it."""
    words = raw.lower().split()
    if not words:
        return 0
    hash_of, text = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:  # one shingle, and over half of one is one
        return hash_of(text, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        part = [hash_of(text[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``id, fp`` of every whole text; ``fp`` holds the 64 bits as a signed long.

    Null or wordless texts have fingerprint 0; a text of fewer words than a shingle has one
    shingle, all of it.
    """
    def run(batches):
        for ids, texts in text_blocks(batches):
            fps = np.array([fingerprint(t.encode(), shingle) for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["id", "fp"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    m = max_bits + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _keys(fp: Column, max_bits: int) -> Column:
    """All keys of a fingerprint: ``key`` and whether it only asks."""
    ring, out = segments(max_bits), []
    for i, (start, width) in enumerate(ring):
        nxt, wide = ring[(i + 1) % len(ring)]
        mask = ((1 << width) - 1) << start | ((1 << wide) - 1) << nxt
        own = fp.bitwiseAND(F.lit(_signed(mask)))
        out.append((i, own, False))
        out += [(i, own.bitwiseXOR(F.lit(_signed(1 << nxt + b))), True) for b in range(wide)]
    return F.array(*[F.struct(F.lit(i).cast("byte").alias("start"), key.alias("key"), F.lit(asks).alias("asks")) for i, key, asks in out])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _joined(fps: np.ndarray, asks: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``max_bits`` among the rows of one key, none twice over."""
    fps, asks = np.asarray(fps, np.int64), np.asarray(asks, bool)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for part in _parts(fps.view(np.uint64), np.arange(len(fps)), max_bits):
        near_fps, values = fps[part], fps[part].tolist()
        for f in fps[part[~asks[part]]].tolist():
            near = np.flatnonzero(np.bitwise_count((near_fps ^ f).view(np.uint64)) <= max_bits).tolist() if len(values) > 32 else [
                j for j, g in enumerate(values) if ((f ^ g) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits]
            for j in near:
                g = values[j]
                if g != f and (a := find(f)) != (b := find(g)):
                    root[max(a, b)] = min(a, b)
                    links.append((f, g))
    return links


def _parts(fps: np.ndarray, rows: np.ndarray, max_bits: int):
    """Rows in parts of at most ``MOST_TOGETHER``, any two within ``max_bits`` together in one of them.

    Equal values can't be told apart further and make a part of any size; a key has none but
    what is both stored and asked.
    """
    if len(rows) <= MOST_TOGETHER:
        yield rows
        return
    own = fps[rows]
    differ = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [b for b in range(BITS) if differ >> b & 1]
    if len(bits) <= max_bits:
        yield rows
        return
    for k in range(max_bits + 1):
        mask = sum(1 << b for b in bits[k :: max_bits + 1])
        at = own & np.uint64(mask)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order])) + 1
        for part in np.split(rows[order], edges):
            if len(part) > 1:
                yield from _parts(fps, part, max_bits)


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``max_bits`` of each other.

    ``distinct`` has a column ``fp`` without repeats. Two fingerprints within the distance
    are joined by a path of such links, though not always by a link of their own.
    """
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held = []
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if not len(now[0]):
                    continue
                held.append(now)
                if all(held[0][i][0] == now[i][-1] for i in (0, 1)):
                    continue  # one key so far: joined when it ends
            if not held:
                continue
            start, key, fp, asks = (np.concatenate(x) for x in zip(*held))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1
            last = len(key) if batch is None else int(edge[-1]) if len(edge) else 0
            bounds = np.concatenate(([0], edge[edge < last], [last])) if last else np.zeros(1, np.int64)
            if len(bounds) > 1:
                stored = np.add.reduceat((~asks[:last]).astype(np.int64), bounds[:-1])
                found = []
                for g in np.flatnonzero((np.diff(bounds) > 1) & (stored > 0)):
                    rows = slice(bounds[g], bounds[g + 1])
                    found += _joined(fp[rows], asks[rows], max_bits)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)
            held = [[x[last:] for x in (start, key, fp, asks)]] if last < len(key) else []

    keyed = distinct.select("fp", F.inline(_keys(F.col("fp"), max_bits)))
    dealt = keyed.select("start", "key", "fp", "asks").repartition("start", "key").sortWithinPartitions("start", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, label``: the smallest fingerprint that each one with a link reaches; others keep their own.

    Each round takes the smallest label among a node's neighbours, offers it to the node and
    to the node's label, and then follows labels one step; chains shorten by more than half.
    """
    both = materialise(edges.union(edges.select("b", "a")), "simhash-links")
    labels = materialise(both.select(F.col("a").alias("fp")).distinct().withColumn("label", F.col("fp")), "simhash-labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("fp")).agg(F.min("theirs").alias("theirs"))
        seen = labels.join(near, "fp")
        offers = seen.select("fp", "theirs").union(seen.select(F.col("label").alias("fp"), "theirs"))
        best = offers.groupBy("fp").agg(F.min("theirs").alias("offer"))
        hooked = labels.join(best, "fp").select("fp", "label", F.least("label", "offer").alias("next"))
        parent = hooked.select(F.col("fp").alias("next"), F.col("next").alias("over"))
        moved = materialise(hooked.join(parent, "next").select("fp", "label", F.least("next", "over").alias("next")), "simhash-labels")
        done = not moved.filter("next <> label").head(1)
        labels = moved.select("fp", F.col("next").alias("label"))
        if done:
            break
    return nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def groups(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``id, fp, component``: fingerprint of each row and the smallest id it reaches.

    Rows with equal or close fingerprints (at most ``max_bits`` bits) are linked, also empty
    ones; null ids are never the smallest, and a group of null ids alone has a null
    component. Repeated rows each give a row. An empty table gives no rows.
    """
    if not 0 <= max_bits < BITS:
        raise ValueError("max_bits must be from 0 to 63")
    fps = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    named = nodes.withColumn("label", F.col("fp"))
    if max_bits:
        named = components(nodes.select("fp"), links(nodes.select("fp"), max_bits)).join(nodes, "fp")
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    of_fp = named.select("fp", "label").join(least, "label").select("fp", "component")
    return fps.join(of_fp, "fp").select("id", "fp", "component")
