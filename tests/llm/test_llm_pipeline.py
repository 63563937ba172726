import random
import sys
import types
import weakref

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerwatch.llm import byte_bpe, containment, pii_crf, simhash_ring, toxicity_gru
from ledgerwatch.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_groups(docs):
    fps = [simhash_ring.fingerprint((d.text or "").encode()) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(docs))]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and result, in turn."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        rows = result.collect()
        out.append((sorted(docs.collect(), key=lambda r: r.doc_id), rows, result.columns))
        docs = spark.createDataFrame(rows, result.schema)
    return out


def test_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(c == columns for _, _, c in stages[:-1])


def test_toxicity(spark, stages):
    before, after, _ = stages[0]
    net = toxicity_gru.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    keep = net.scores([d.text or "" for d in before]) < 0.5
    assert sorted(after) == sorted(d for d, k in zip(before, keep) if k)


def test_near_duplicates(stages):
    before, after, _ = stages[1]
    assert sorted(after) == sorted(d for i, (d, g) in enumerate(zip(before, plain_groups(before))) if g == i)


def test_decontamination(spark, stages):
    before, after, _ = stages[2]
    items = [set(containment.shingles_of(containment.words_of(r.text), 5)) for r in table(spark, SF, "benchmark").collect()]
    grams = [set(containment.shingles_of(containment.words_of(d.text or ""), 5)) for d in before]
    clean = [not any(len(i & g) >= 0.8 * len(i) for i in items if i) for g in grams]
    assert sorted(after) == sorted(d for d, k in zip(before, clean) if k)


def test_personal_data(stages):
    before, after, _ = stages[3]
    field = pii_crf.standard_field()
    added = pii_crf.field_spans(field, [d.text for d in before])
    want = {d.doc_id: pii_crf.masked(d.text, pii_crf.all_spans(pii_crf.pattern_spans(d.text), a)) for d, a in zip(before, added)}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert any(t != d.text for d, t in zip(before, want.values()))


def test_token_ids(stages):
    before, after, _ = stages[4]
    ranks = byte_bpe.Ranks(byte_bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert {r.doc_id: bytes(r.ids) for r in after} == {d.doc_id: ranks.encode(d.text) for d in before}
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in after)


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1][1])


def test_odd_documents(spark):
    """Nulls, empty and repeated rows through every stage but the first, which needs labels of its own."""
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(900)}" for _ in range(200))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", 0),
            (4, "", "en", "s", 0), (5, f"other words here {text[::-1]}", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 5]
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0) if "text" in docs.columns else docs, SF).count() == 0


def test_one_id_on_two_texts(spark):
    """Each text counts in its own group: no copy survives, no text is lost."""
    rnd = random.Random(2)
    a, b, c = (" ".join(f"w{rnd.randrange(900)}" for _ in range(120)) for _ in range(3))
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (7, b, "de"), (9, b, "en"), (None, c, "en"), (None, c, "fr"), (None, a, "en"), (None, "", "en"), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("component", F.lit("x")).withColumn("fp", F.lit(1))
    for order in (docs, docs.orderBy(F.desc("text"), "lang")):
        kept = corpus_pipeline.one_of_each_group(spark, order, SF)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text or "", r.lang) for r in kept.collect()), key=str)
        assert got == sorted([(3, a, "en"), (7, b, "de"), (None, c, "en"), (None, "", "en")], key=str)


class Value:
    """An object that can be watched."""


def test_a_worker_holds_the_value_of_one_operator(monkeypatch):
    from ledgerwatch.llm.common import worker_value

    monkeypatch.setitem(sys.modules, "_ledgerwatch_worker", types.SimpleNamespace())
    made = []

    def value(key):
        return worker_value(key, lambda: made.append(key) or [key])

    first = weakref.ref(kept := Value())
    assert worker_value("large", lambda: kept) is kept
    del kept
    assert first() is not None and value("a") is value("a") and made == ["a"]
    assert first() is None  # let go when another operator's value was made
    assert value("b") == ["b"] and value("a") == ["a"] and made == ["a", "b", "a"]
