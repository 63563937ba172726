import random
import re

import numpy as np
import xxhash

from ledgerwatch.llm import containment, simhash_ring


def plain_fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, bits=2):
    """Smallest index reached by each fingerprint over links of at most ``bits`` bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rnd.choice(["The", "ÄÖ", "x", "yy\t", "Z\n"]) for _ in range(n))
        assert simhash_ring.fingerprint(text.encode()) == plain_fingerprint(text)


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(str(i % 97) for i in range(500))
    whole = simhash_ring.fingerprint(text.encode())
    monkeypatch.setattr(simhash_ring, "BLOCK", 7)
    assert simhash_ring.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_links_and_components(spark):
    """All links between close fingerprints: chains, dense balls and far ones."""
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(12):  # chains of one or two flips
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(2, 30)):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 2))))
            fps.add(x)
    center = rnd.getrandbits(64)
    few = rnd.sample(range(64), 9)
    for _ in range(200):
        fps.add(center ^ sum(1 << b for b in few if rnd.random() < 0.4))
    for _ in range(100):  # three flips: not linked
        fps.add(rnd.choice(sorted(fps)) ^ sum(1 << b for b in rnd.sample(range(64), 3)))
    fps = sorted(fps)
    signed = [simhash_ring._signed(f) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    edges = simhash_ring.links(nodes, 2)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges.collect())
    got = {r.fp: r.label for r in simhash_ring.components(nodes, edges).collect()}
    want = plain_groups(fps)
    groups, theirs = {}, {}
    for f, s, w in zip(fps, signed, want):
        groups.setdefault(w, set()).add(s)
        theirs.setdefault(got[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_other_distances(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(20)]
    for bits in (1, 3):
        fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(0, 5))) for b in base for _ in range(6)})
        signed = [simhash_ring._signed(f) for f in fps]
        nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
        got = {r.fp: r.label for r in simhash_ring.components(nodes, simhash_ring.links(nodes, bits)).collect()}
        want = plain_groups(fps, bits)
        assert len(set(got.values())) == len(set(want))


def test_hot_keys_are_cut_and_lose_nothing(spark, monkeypatch):
    """Thousands of fingerprints with one key, in many batches; parts of at most 50 rows."""
    rnd = random.Random(6)
    fps = {rnd.getrandbits(20) << 43 | 5 for _ in range(700)} | {rnd.getrandbits(64) for _ in range(50)}
    for x in rnd.sample(sorted(fps), 200):
        fps.add(x ^ sum(1 << b for b in rnd.sample(range(43, 63), rnd.choice((1, 2, 3)))))
    fps = sorted(fps)
    monkeypatch.setattr(simhash_ring, "MOST_TOGETHER", 50)
    signed = np.array([simhash_ring._signed(f) for f in fps], np.int64)
    parts = list(simhash_ring._parts(signed.view(np.uint64), np.arange(len(fps)), 2))
    assert max(map(len, parts)) <= 50 and len(parts) > 30
    nodes = spark.createDataFrame([(int(f),) for f in signed], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.fp: r.label for r in simhash_ring.components(nodes, simhash_ring.links(nodes, 2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups, theirs = {}, {}
    for s, w in zip(signed.tolist(), plain_groups(fps)):
        groups.setdefault(w, set()).add(s)
        theirs.setdefault(got[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_rows_of_one_key_leave_few_links():
    rnd = random.Random(2)
    fps = sorted({sum(1 << b for b in range(12) if rnd.random() < 0.5) for _ in range(2000)})
    found = simhash_ring._joined(fps, [False] * len(fps), 2)
    assert len(found) == len(fps) - 1


def test_groups_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(5, text), (3, text), (3, text), (None, text), (8, None), (6, ""), (9, " \n\t"), (4, "one"), (7, "ONE"), (None, "alone here now indeed")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component string")
    got = simhash_ring.groups(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by_id = {r.id: r.component for r in got if r.id is not None}
    assert by_id == {5: 3, 3: 3, 8: 6, 6: 6, 9: 6, 4: 4, 7: 4}
    assert sorted((r.component for r in got if r.id is None), key=str) == [3, None]
    assert simhash_ring.groups(df.limit(0), "doc_id", "text").count() == 0


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    from ledgerwatch.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op8_simhash_groups"](spark, "/root/testdata/sf0.001").collect()}
    fps = [plain_fingerprint(d.text) for d in docs]
    for d, f, w in zip(docs, fps, plain_groups(fps)):
        assert got[d.doc_id].fingerprint == f"{f:016x}"
        assert got[d.doc_id].component_id == docs[w].doc_id


def plain_words(text):
    return "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower().replace("ß", "ss")).split()


def plain_contained(docs, items, size=5, least=0.8):
    def grams(text):
        words = plain_words(text)
        return words, set(containment.shingles_of(words, size))

    out = set()
    for i, item in set(items):
        words, want = grams(item)
        for d, text in docs:
            have = set(zip(*(plain_words(text)[k:] for k in range(min(size, len(words))))))
            if want and len(want & have) / len(want) >= least - 1e-12:
                out.add((d, i, len(want), len(want & have)))
    return out


def test_contained_items(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice((1, 3, 5, 6, 12, 40, 70))))) for k in range(30)]
    items += [(30, ""), (31, None), (32, items[0][1]), (0, items[0][1]), (None, items[3][1])]
    docs = []
    for d in range(80):
        text = [rnd.choice(words) for _ in range(rnd.randrange(0, 300))]
        for _ in range(rnd.randrange(3)):
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randrange(3)):  # some wording changed
                if part:
                    part[rnd.randrange(len(part))] = rnd.choice(words)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = [p.upper() if rnd.random() < 0.3 else p for p in part]
        docs.append((d, "\n".join(text)))
    docs += [(200, None), (201, ""), (None, items[5][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string")
    it = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = {(r.id, r.item, r.n_shingles, r.n_shared) for r in containment.contained(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == plain_contained(docs, items)
    clean = containment.clean_rows(df, "text", it, "item_id", "text")
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in got}
    assert containment.contained(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert containment.contained(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_BYTES", 300)
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k}") for k in range(40)]
    it = spark.createDataFrame(items, "item_id long, text string")
    files = containment.blocks(it, "item_id", "text")
    assert len(files) > containment.KEPT_BLOCKS  # so the workers can't keep them all
    repeated = containment.blocks(it.union(it).union(it), "item_id", "text")
    held = [sorted(i for i, _ in index.items) for index in containment._indexes(repeated)]
    assert sorted(i for h in held for i in h) == list(range(40))
    assert containment.blocks(it.selectExpr("item_id", "' . ' as text"), "item_id", "text") == []
    df = spark.createDataFrame([(k, "start " + t + " end") for k, t in items] + [(99, "nothing")], "doc_id long, text string")
    assert {(r.id, r.item) for r in containment.contained(df, "doc_id", "text", it, "item_id", "text").collect()} == {(k, k) for k, _ in items}
    assert [r.doc_id for r in containment.clean_rows(df, "text", it, "item_id", "text").collect()] == [99]


def test_signature_never_misses():
    """Any text with at least 80 % of an item's shingles holds one hash of the signature."""
    rnd = random.Random(8)
    for n in (1, 2, 3, 5, 9, 16, 31, 64):
        words = [f"a{i}" for i in range(n + 4)]
        index = containment.Index([(0, " ".join(words))], 5, 0.8)
        keys, _ = index.signatures[5]
        grams = np.array(sorted(index.items[0][1]), np.int64)
        hashes = set(index.hashes(grams.T).tolist())
        for _ in range(20):
            lacking = set(rnd.sample(sorted(hashes), int(0.2 * n + 1e-9)))
            assert (hashes - lacking) & set(keys.tolist())
