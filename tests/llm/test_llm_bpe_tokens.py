import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerwatch.llm import byte_bpe, token_file
from ledgerwatch.llm.common import byte_blocks, shared_folder
from ledgerwatch.session import materialise

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a \n b", "\n\n x", "don't we'll", "a  b  c", "1 22  333", "é è\tü", "aaaaaaaaaaaaaaaaaaaa", "<|endoftext|> x",
       "᠎x ᠎ y", " ﻿z", "x\x1c y \x1cz", "日本語 の テスト", "🙂 🙂🙂", "a" * 3000, "ab " * 500, "th" * 2000 + " end"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(byte_bpe.rank_file(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def judge():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_same_ids_as_the_library(ranks, judge):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab eé\n'st1 .") for _ in range(rnd.randrange(60))) for _ in range(400)]
    for text in texts:
        ids = ranks.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == judge.encode_ordinary(text), repr(text)
        assert ranks.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    global _RANKS, _JUDGE
    try:
        _RANKS
    except NameError:
        _RANKS = byte_bpe.Ranks(byte_bpe.rank_file(RANKS), P.PATTERN)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        _JUDGE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    ids = _RANKS.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == _JUDGE.encode_ordinary(text)


def test_merge_against_plain_loop(ranks):
    """Lowest rank first, leftmost among equals, by scanning all pairs each time."""
    def plain(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            found = [(ranks.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.ranks]
            if not found:
                return [ranks.ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(1)
    for _ in range(300):
        raw = bytes(rnd.choice(b"thenaio rs") for _ in range(rnd.randrange(1, 40)))
        assert ranks.merge(raw) == (plain(raw) if raw not in ranks.ranks else [ranks.ranks[raw]])
    assert not any(ranks._leaf)  # the bitmap is empty again


def test_very_long_pre_token(ranks):
    import time

    raw = bytes(random.Random(2).choice(b"abcdefgh") for _ in range(200_000))
    begin = time.perf_counter()
    ids = ranks.merge(raw)
    assert b"".join(ranks.bytes_of[i] for i in ids) == raw
    assert time.perf_counter() - begin < 20


def test_frame_with_odd_rows(spark, judge):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "tests", "y"), (3, None, None), (4, "", "z")] + [(10 + i, t, "") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "id")
    got = byte_bpe.round_trip(df, "doc_id", "text", RANKS, P.PATTERN).collect()
    want = sorted(((i is None, i or 0, bytes(np.array(judge.encode_ordinary(t or ""), "<u4")), (t or "").encode()) for i, t, _ in rows))
    assert sorted((r.id is None, r.id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    back = byte_bpe.decode(byte_bpe.encode(df, "doc_id", "text", RANKS, P.PATTERN), "id", "ids", RANKS, P.PATTERN)
    assert {(r.id, r.text) for r in back.collect()} == {(i, t or "") for i, t, _ in rows}
    assert byte_bpe.round_trip(df.limit(0), "doc_id", "text", RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("ends", [[1], [1, 2, 3], [5, 5, 5, 9], list(range(1, 2000)), [10**6], [3, 10**7, 10**7 + 1]])
def test_elias_fano(ends):
    ef = token_file.EliasFano.of(np.array(ends, np.int64))
    assert [ef.select(i) for i in range(len(ends))] == ends
    assert ef.range(0, len(ends)).tolist() == ends
    for a, b in ((0, 1), (len(ends) // 2, len(ends)), (len(ends) - 1, len(ends)), (1, 1)):
        assert ef.range(a, b).tolist() == ends[a:b]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=900), st.data())
def test_elias_fano_any(lengths, data):
    ends = np.cumsum(lengths)
    ef = token_file.EliasFano.of(ends)
    a = data.draw(st.integers(0, len(ends) - 1))
    b = data.draw(st.integers(a, len(ends)))
    assert ef.range(a, b).tolist() == ends[a:b].tolist()
    assert ef.select(a) == ends[a]


def test_boundaries_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    bits = 8 * token_file.EliasFano.of(ends).n_bytes() / len(ends)
    assert bits < np.log2(ends[-1] / len(ends)) + 2.6


def test_token_files(spark):
    rows = [(7, "a b"), (7, "a b"), (None, "null id"), (3, None), (2, "")] + [(20 - i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    folder = shared_folder(spark, "test-tokens")
    manifest = materialise(token_file.write(df, "doc_id", "text", VOCABULARY, folder), "test-manifest")
    got = sorted(token_file.read(spark, folder, manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert [r.id for r in got] == [i for i, _ in order]
    for r, (_, text) in zip(got, order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    sums = {(r.start, r.crc) for r in token_file.checksums(spark, folder, manifest).collect()}
    assert sums == {(r.start, zlib.crc32(bytes(r.ids))) for r in got}
    assert token_file.round_trip(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


def test_files_roll_and_one_id_is_dealt_over_tasks(spark, monkeypatch):
    """Many rows of one id, of none, and copies; the files follow one another in order of id and text."""
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 5, 5, 5, 9]), " ".join(rnd.choice(["a", "bc", "the"]) for _ in range(rnd.randrange(40)))) for _ in range(600)] + [(5, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = shared_folder(spark, "test-tokens-roll")
    monkeypatch.setattr(token_file, "FILE_DOCS", 25)
    monkeypatch.setattr(token_file, "byte_blocks", lambda batches, _: plain_blocks(batches, 200))
    plain_blocks = byte_blocks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one task
    try:
        manifest = materialise(token_file.write(df, "doc_id", "text", VOCABULARY, folder), "test-manifest")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.collect()
    assert len(files) > 12 and len({r.part for r in files}) > 3 and sum(r.n_docs for r in files) == len(rows)
    got = sorted(token_file.read(spark, folder, manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    library, start = Tokenizer.from_file(VOCABULARY), 0
    for r, (i, text) in zip(got, order, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (i, start, ids)
        start += len(ids)


def test_damaged_file_is_noticed(tmp_path):
    from pyarrow import fs

    system = fs.LocalFileSystem()
    token_file.write_file(system, f"{tmp_path}/x.eft", [1, 2], [np.arange(7, dtype="<u2").tobytes()], np.array([3, 4]), 2)
    raw = (tmp_path / "x.eft").read_bytes()
    for bad in (raw[:-1], raw[:20], b"", raw[:6] + raw[8:]):
        (tmp_path / "y.eft").write_bytes(bad)
        with pytest.raises(ValueError):
            token_file.TokenFile(system, f"{tmp_path}/y.eft")


def test_pieces_against_the_library(monkeypatch):
    """Any texts, many pieces to one call, a small store that forgets, and hashes that collide."""
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    rnd = random.Random(7)
    odd = ["a", "b", " ", "  ", "\n", "\t ", "é", "ß ", "'s", " \u2003", "\u00a0", "1", ".", " “x”", "日", "\u180e", "\x1c", "\x85", "the", " and"]
    pieces = token_file.Pieces(open(VOCABULARY, "rb").read())
    plain = token_file.range_hashes
    for kept, hashes in ((10**6, plain), (30, plain), (10**6, lambda *a: plain(*a) % np.uint64(50))):
        monkeypatch.setattr(token_file, "KEPT_PIECES", kept)
        monkeypatch.setattr(token_file, "range_hashes", hashes)
        pieces.clear()
        for _ in range(30):
            texts = ODD * (rnd.random() < 0.2) + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(30))) for _ in range(20)]
            data = np.frombuffer("".join(texts).encode(), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
            ids, lengths = pieces.encode(data, offsets, 7)
            want = [[*x.ids, 7] for x in library.encode_batch(texts, add_special_tokens=False)]
            assert lengths.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_added_tokens_as_the_library_by_default():
    library = Tokenizer.from_file(VOCABULARY)  # untouched
    pieces = token_file.Pieces(open(VOCABULARY, "rb").read(), added=True)
    rnd, odd = random.Random(8), ["a", " b", " ", "\n", "é", "<|endoftext|>", "<|endoftext|", "|>", "<", "the "]
    for _ in range(60):
        texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(8))) for _ in range(rnd.randrange(12))] + ODD * (rnd.random() < 0.2)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)))
        ids, lengths = pieces.encode(data, offsets, 0)
        want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_checksums_of_texts_with_added_tokens(spark):
    texts = ["a b", "a <|endoftext|> b", "", "<|endoftext|>", "after"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_file.round_trip(df, "doc_id", "text", VOCABULARY).collect()) == want


def test_random_access(spark, tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 50, 1000)
    ids = rng.integers(0, 50257, lengths.sum()).astype("<u2")
    names = [None, *range(1, 1000)]
    token_file.write_file(fs.LocalFileSystem(), f"{tmp_path}/x.eft", names, [ids.tobytes()], lengths, 2)
    f = token_file.TokenFile(fs.LocalFileSystem(), f"{tmp_path}/x.eft")
    ends = np.cumsum(lengths)
    for i in (0, 1, 255, 256, 257, 511, 999):
        assert f.ids(i).tolist() == ids[ends[i] - lengths[i] : ends[i]].tolist()
    assert f.doc_ids[5] == 5 and not f.known[0]


def test_digest_of_decoded(spark):
    from ledgerwatch.llm.queries import QUERIES

    rows = QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
