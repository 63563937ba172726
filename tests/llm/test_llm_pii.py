import hashlib
import random
import re

import numpy as np
import pytest

from ledgerwatch.llm import pii_crf as C

PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    """The patterns as they stand, then their checks."""
    out = []
    for m in PLAIN[0].finditer(text):
        out.append((m.start(), 0, m.end()))
    for m in PLAIN[1].finditer(text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in PLAIN[2].finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in PLAIN[3].finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return C.standard_field()


def test_patterns_against_plain_ones():
    rnd = random.Random(6)
    texts = ["a@b.c@d.e", "@b.c", "x@y", "a@b-.c.", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 01.002.3.255", "4111 1111 1111 1111 5500-0000-0000-0004",
             "4111-1111--1111", "+1 (234) 567-8901", "+1 23", "++12345678901", "٣٣٣٣", "a" * 500 + "@" + "b." * 300 + "c", "1." * 999, "0" * 3000, "é@é.é x@é.fr"]
    texts += ["".join(rnd.choice("0123 9.@+-()ab é") for _ in range(rnd.randrange(80))) for _ in range(3000)]
    texts += ["".join(rnd.choice(["4111111111111111", "1.2.3.4", "a@b.co", "+12 345 678 90", " ", "-", ".", "7", "x"]) for _ in range(9)) for _ in range(1000)]
    for t in texts:
        assert C.pattern_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 150_000, "a." * 200_000 + "@", "1 " * 200_000])
def test_linear_time(text):
    import time

    begin = time.perf_counter()
    C.pattern_spans(text)
    assert time.perf_counter() - begin < 5


def test_held_out_sentences(field):
    rows = C.labelled_rows(400, seed=101)
    got = C.field_spans(field, [t for t, _ in rows])
    right = sum(len(set(s) & set(g)) for (_, s), g in zip(rows, got))
    assert right / sum(len(s) for _, s in rows) > 0.95
    assert right / max(1, sum(map(len, got))) > 0.95


def test_adds_what_patterns_miss(field):
    texts = ["please call 555-123-4567 or", "her ssn 123-45-6789 was", "nothing of the kind here", "Licensed under the Apache License, Version 2.0."]
    base = [C.pattern_spans(t) for t in texts]
    assert base == [[], [], [], []]
    kinds = [[C.ALL_KINDS[k] for _, k, _ in s] for s in C.field_spans(field, texts)]
    assert kinds == [["phone"], ["person_id"], [], []]


def plain_viterbi(field, types):
    """Best labels of one text by the textbook recursion over all its words."""
    w, t, n = field.weights, field.trans, len(types)
    around = [0, *types, 0]
    emit = [w[0][around[i]] + w[1][around[i - 1]] + w[2][around[i + 1]] for i in range(1, n + 1)]
    score, back = t[C.OUTSIDE] + emit[0], []
    for e in emit[1:]:
        options = score[:, None] + t
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + e
    path = [int((score + t[:, C.OUTSIDE]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def path_score(field, types, labels):
    w, t, around, total, previous = field.weights, field.trans, [0, *types, 0], 0.0, C.OUTSIDE
    for i, label in enumerate(labels):
        total += t[previous, label] + w[0][around[i + 1]][label] + w[1][around[i]][label] + w[2][around[i + 2]][label]
        previous = label
    return total + t[previous, C.OUTSIDE]


def test_decoding_is_exact(field):
    rng = np.random.default_rng(4)
    for strength in (0.3, 1.0):  # weak weights leave long open stretches
        loose = C.Field(field.shapes, field.cues)
        loose.weights, loose.trans = field.weights * strength, field.trans + rng.normal(0, 1, field.trans.shape)
        loose.finish()
        texts = [rng.integers(6, loose.weights.shape[1], rng.integers(1, 40)) for _ in range(60)]
        texts += [[loose.type_of(w) for w in t.split()] for t, _ in C.labelled_rows(60, seed=9)]
        flat = np.concatenate([[0], *[[*t, 0] for t in texts]]).astype(np.int64)
        got, at = C.decode(loose, flat), 1
        for t in texts:
            found, best = got[at : at + len(t)].tolist(), plain_viterbi(loose, list(t))
            assert found == best or abs(path_score(loose, t, found) - path_score(loose, t, best)) < 1e-9  # a tie
            at += len(t) + 1


def test_rows_of_the_frame(spark, field):
    rows = [(1, "mail a.b@c.de and 10.0.0.1, +1 (234) 567-8901"), (1, "mail a.b@c.de and 10.0.0.1, +1 (234) 567-8901"), (None, "x@y.z"), (3, None), (4, ""),
            (5, "word " * 30_000 + "card 4111 1111 1111 1111")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = C.find(df, "doc_id", "text", field).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id == 1:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
            assert [(s.kind, s.start, s.end) for s in r.base] == [("email", 5, 13), ("ip", 18, 26), ("phone", 28, 45)]
        if r.id in (3, 4):
            assert r.base == r.spans == []
        if r.id == 5:
            assert r.n_card == 1 and r.base[0].end == 150_000 + 24
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert C.find(df.limit(0), "doc_id", "text", field).count() == 0


def test_mask_keeps_rows_and_columns(spark, field):
    df = spark.createDataFrame([(1, "to a@b.cd and +1 (234) 567-8901!", 99, "k"), (2, None, None, "k"), (3, "plain", 7, None)], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r for r in C.mask(df, "text", field, "n_chars").collect()}
    assert got[1].text == "to <EMAIL> and <PHONE>!" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text, got[3].n_chars, got[3].base) == (None, None, "plain", 7, None)
    assert C.mask(df, "text", field).columns == df.columns
    assert C.masked("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a<EMAIL>f"


def test_digest_of_the_query(spark):
    from ledgerwatch.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op1_pii"](spark, "/root/testdata/sf0.001").collect():
        base = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(C.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, C.written(base).split(","))) <= set(r.spans.split(","))


def test_no_rows_to_learn_from():
    assert C.field_spans(C.train([]), ["a b 1"]) == [[]]


def test_long_words_differ_by_all_their_runs():
    """The shape of a word has all its runs, also behind the sixteenth."""
    start = "1a-" * 12
    assert C.shape(start + "@x") != C.shape(start + "9") != C.shape(start + "b")
    text = "word " + "1a-" * 50_000 + "z end"
    assert C.all_spans(C.pattern_spans(text), C.field_spans(C.standard_field(), [text])[0]) is not None
