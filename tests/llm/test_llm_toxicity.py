import random
import zlib

import numpy as np
import pytest

from ledgerwatch.llm import toxicity_gru as T

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "ta", "vo") for b in ("ban", "der", "fil", "gos", "hem", "jor", "kul")]
BAD = ["scumbag", "idiotic", "wertlos"]


def some_texts(n, seed):
    rnd, texts, toxic = random.Random(seed), [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(5, 150))]
        bad = i % 3 == 0
        for _ in range(1 + len(words) // 40 if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def net():
    return T.fit(*some_texts(500, 1))


def test_held_out_accuracy(net):
    texts, toxic = some_texts(300, 2)
    assert ((net.scores(texts) >= 0.5) == toxic).mean() > 0.97


def test_one_bad_window_in_a_long_text(net):
    rnd = random.Random(3)
    words = [rnd.choice(WORDS) for _ in range(5000)]
    clean = net.scores([" ".join(words)])[0]
    for at in (0, 31, 32, 2500, 4999):
        worse = net.scores([" ".join([*words[:at], "scumbag", "idiotic", *words[at:]])])[0]
        assert worse >= 0.5 > clean


def test_score_does_not_depend_on_neighbours(net):
    texts, _ = some_texts(40, 5)
    alone = np.array([net.scores([t])[0] for t in texts])
    assert np.allclose(alone, net.scores(texts), atol=1e-5)
    assert net.scores(["", "!!! ...", "é"]).shape == (3,) and (net.scores(["", " \n"]) == 0).all()


def test_windows_cover_all_words():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    starts, lengths, text = T.windows_of(counts)
    base = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        mine = text == k
        covered = {w for s, l in zip(starts[mine] - base[k], lengths[mine]) for w in range(s, s + l)}
        assert covered == set(range(n))
        assert all(s + l <= n for s, l in zip(starts[mine] - base[k], lengths[mine]))


def test_words_and_chunks(monkeypatch):
    texts = ["Ab ab, x1!", "", "éa ÉA the the", "z" * 50 + " ab"]
    def shapes(w):
        return w.counts.tolist(), [(w.which == k).sum() for k in w.which]
    whole = T.Words(texts)
    assert whole.counts.tolist() == [3, 0, 4, 2]
    assert whole.which[0] == whole.which[1] == whole.which[8] and whole.which[3] == whole.which[4]
    monkeypatch.setattr(T, "CHUNK", 4)
    cut = T.Words(texts)
    assert shapes(cut) == shapes(whole)
    rows = np.arange(len(whole.hashes))
    grams, lengths = whole.grams(rows)
    assert lengths.sum() == len(grams) and lengths.max() == 50


def test_gradients():
    """Backward pass against finite differences."""
    texts, toxic = some_texts(12, 8)
    words = T.Words(texts)
    starts, lengths, text = T.windows_of(words.counts)
    labels, weights = toxic[text], np.ones(len(text))
    for name in ("Uf", "Ub", "A", "v", "w", "Wx", "b", "a", "bx"):
        net = T.Network(1)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        net.slopes = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}

        def loss():
            z = net.logits(words, starts, lengths).astype(float)
            return float(np.mean(np.logaddexp(0, z) - labels * z))

        spot = tuple(0 for _ in net.p[name].shape)
        step = 1e-2
        net.p[name][spot] += step
        up = loss()
        net.p[name][spot] -= 2 * step
        down = loss()
        net.p[name][spot] += step
        before = {k: v.copy() for k, v in net.p.items()}
        net.learn(words, starts, lengths, labels, weights, 0.0)
        slope = net.slopes[name][0][spot] / 0.1
        assert np.allclose(before[name], net.p[name])
        assert abs(slope - (up - down) / (2 * step)) < 2e-3, name


def test_one_label_only():
    assert (T.fit(["a b", "c"], np.array([0, 0])).scores(["x", ""]) < 0.5).all()
    assert (T.fit([], np.array([], int)).scores(["x"]) < 0.5).all()


def test_frames(spark):
    texts, toxic = some_texts(400, 11)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "scumbag", "s"), (900, None, "s"), (901, "", None), (0, texts[0], "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(toxic)] + [(None, 1, 1), (5, None, 1), (9999, 1, 1)], "doc_id long, toxic int, label int")
    net = T.train(docs, labels)
    got = T.score(docs, "doc_id", "text", net).collect()
    assert len(got) == len(texts) + 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.id: r.score for r in got}[900] == 0
    held = [r for r in got if r.id is not None and r.id < 400 and zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == toxic[r.id] for r in held]) > 0.95
    clean = T.clean_rows(docs, "text", net)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.id) for r in got if r.score < 0.5)
    assert T.train(docs, labels.limit(0)).scores(["scumbag"])[0] < 0.5
    assert T.score(docs.limit(0), "doc_id", "text", net).count() == 0


def test_held_out_rows_never_train(spark):
    docs = spark.createDataFrame([(i, f"w{i} text") for i in range(200)], "doc_id long, text string")
    part = docs.select("doc_id", T.in_test_part(docs.doc_id).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in part)
    labels = spark.createDataFrame([(r.doc_id, int(r.held)) for r in part], "doc_id long, toxic int")
    assert (T.train(docs, labels).scores([f"w{i} text" for i in range(200)]) < 0.5).all()  # only zeros are left


def test_held_out_accuracy_of_the_query(spark):
    from ledgerwatch.llm.queries import QUERIES

    got = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert len(got) == 1000 and (got.predicted == (got.score >= 0.5)).all()
