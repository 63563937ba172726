"""Phrase collocations, mixing of sources and ranked search against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerwatch.llm import mixing, phrase_graph, ranked_search

DOCS = "doc_id long, text string, lang string, source string, id string, words string, score long, part int"


def rows_of(texts, lang=lambda i: "en", source=lambda i: "s"):
    """Documents with further columns whose names the operators use inside."""
    return [(i, t, lang(i), source(i), "x", "y", 7, 1) for i, t in enumerate(texts)]


# -- phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, least, top, covered):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows(spark, rows, **how):
    found = phrase_graph.collocations(spark.createDataFrame(rows, DOCS), "text", "lang", **how)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_plain_counts(spark):
    rnd = random.Random(5)
    words = ["Red", "ROT", "blue", "é", "x\x1cy", "Ä", "de", "of", "the"]
    passage = "one long passage of many words that comes again and again, as it is"
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", "\t", "\n", ",", "  "]) for _ in range(rnd.randrange(0, 60))) for _ in range(120)]
    texts += [passage] * 9 + [passage + " " + rnd.choice(words) for _ in range(5)] + [None, "", " \t", "...", "of of of of of of of of"] * 3
    rows = rows_of(texts, lang=lambda i: [None, "en", "de\nx", "und"][i % 4])
    for least, top, covered in ((3, 2000, 80), (5, 7, 50), (2, 40, 100)):
        assert phrase_rows(spark, rows, least=least, top=top, covered=covered) == plain_phrases(rows, least, top, covered)


def test_phrases_of_small_blocks_and_long_pieces(spark, monkeypatch):
    """Buckets added up in steps, texts cut between pieces and between words."""
    rnd = random.Random(6)
    rows = rows_of([" ".join(rnd.choice("abcde") for _ in range(3000)), ". ".join("a b c d"[: rnd.randrange(8)] for _ in range(500)), "z" * 5000])
    monkeypatch.setattr(phrase_graph, "TEXT_BYTES", 200)
    monkeypatch.setattr(phrase_graph, "ROWS", 10)
    assert phrase_rows(spark, rows, least=4) == plain_phrases(rows, 4, 2000, 80)


def test_cuts_lose_no_gram():
    rnd = random.Random(3)
    for turn in range(200):
        text = "".join(rnd.choice(["a", "bb", "c ", " ", ". ", "dd ", " e", "ff "]) for _ in range(rnd.randrange(200)))
        text = text if turn % 3 else text.replace(".", "")
        names, n = phrase_graph.grams_of(list(phrase_graph._cuts(text.encode(), rnd.choice((3, 8, 20, 1000)))))
        whole = Counter()
        for piece in text.split("."):
            w = piece.split()
            whole.update(" ".join(w[i : i + 4]) for i in range(len(w)))
        assert dict(zip((x.decode() for x in names.to_pylist()), n.tolist())) == whole


def test_paths_are_passages(spark):
    """A passage that occurs as a whole is one path; a branch or an end within cuts it."""
    rows = rows_of(["p q r s t u v w"] * 8 + ["k l m n o"] * 6 + ["l m n"] * 2 + ["a b c d e f", "a b c d x y"] * 5)
    counted = phrase_graph.counts(spark.createDataFrame(rows, DOCS), "text", "lang", least=3)
    found = {r["words"]: r["f"] for r in phrase_graph.paths(counted).collect()}
    assert found == {"p q r s t u v w": 8, "k l m n": 6, "l m n o": 6, "a b c d": 10, "b c d e f": 5, "b c d x y": 5}


def test_phrases_broadcast_no_table(spark, monkeypatch):
    """A stored table is far larger than its files, and parts come in copies: no join may send one to the driver."""
    plans, store = [], phrase_graph.materialise
    monkeypatch.setattr(phrase_graph, "materialise", lambda df, label: plans.append(df) or store(df, label))
    rows = rows_of(["a b c d e f. g h. a b", "a b c d e f; g h i"] * 6, lang=lambda i: "en" if i % 3 else "de")
    plans.append(phrase_graph.collocations(spark.createDataFrame(rows, DOCS), "text", "lang", least=3, top=10))
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("SortMergeJoin" in t for t in texts) >= 3 and not any("Broadcast" in t for t in texts)


def test_phrases_of_empty_tables(spark):
    assert phrase_rows(spark, []) == []
    assert phrase_rows(spark, rows_of([None, "", "only once"]), least=2) == []


# -- mixing ----------------------------------------------------------------------------------


def plain_targets(sizes, weights, share, most):
    """Targets by resharing the excess until none is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        over = [s for s in free if left * w[s] / sum(w[f] for f in free) > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / sum(w[f] for f in free) for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def mixed(spark, rows, **how):
    return mixing.mix(spark.createDataFrame(rows, DOCS), "doc_id", "text", "source", **how).collect()


def mixture_rows(n=400):
    rnd = random.Random(8)
    texts = [rnd.choice(["", None, "w " * rnd.randrange(40), "a\tb\nc\x0bd\x0ce\rf", "  x y", " ".join("long" for _ in range(rnd.randrange(200)))]) for _ in range(n)]
    return rows_of(texts, source=lambda i: ["big", None, "tiny", "Z", "é", ""][0 if i % 3 else i % 6])


def test_mix_comes_near_its_targets(spark):
    rows = mixture_rows()
    found = mixed(spark, rows)
    assert sorted(r["id"] for r in found) == list(range(len(rows)))
    size = {i: len(re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sizes = defaultdict(int)
    for i, _, _, s, *_ in rows:
        sizes[s] += size[i]
    wanted, taken, largest = plain_targets(sizes, (3, 1, 2), 1.5, 2), defaultdict(int), defaultdict(int)
    for r in found:
        assert r["size"] == size[r["id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"][0] == pytest.approx(wanted[r["source"]])
        assert r["taken"][0] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"][0]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixes_are_nested_and_repeatable(spark):
    shares = (0.1, 0.5, 1.0, 1.9)
    rows = mixture_rows(200)
    one, two = (sorted((r["id"], tuple(r["taken"]), tuple(r["target"])) for r in mixed(spark, rs, shares=shares)) for rs in (rows, rows[::-1]))
    assert one == two
    assert all(list(taken) == sorted(taken) for _, taken, _ in one)


def test_bounds_of_targets(spark):
    """Every source at its bound, and sources without words."""
    rows = rows_of(["a b c", "d e", "", None], source=lambda i: "abcd"[i])
    assert {r["id"]: (r["target"][0], r["taken"][0]) for r in mixed(spark, rows, shares=(2.0,))} == {0: (6.0, 6), 1: (4.0, 4), 2: (0.0, 0), 3: (0.0, 0)}
    assert all(r["taken"] == [0] and r["target"] == [0.0] for r in mixed(spark, rows_of(["", None, " "], source=lambda i: None)))
    assert mixed(spark, []) == []


def test_repeated_rows_stand_together(spark):
    rows = [(1, "a b", "en", "s", "", "", 0, 0)] * 5 + [(None, f"c {k}", "en", "s", "", "", 0, 0) for k in range(40)]
    found = mixed(spark, rows, weights=(1,), shares=(0.5,))
    assert len({r["taken"][0] for r in found if r["id"] == 1}) == 1
    assert abs(sum(r["taken"][0] for r in found) - 45) <= 5


# -- ranked search ---------------------------------------------------------------------------


def plain_search(rows, items, k=10):
    pattern = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked, scores = Counter(terms(text)), []
        for i, c, n in docs:
            m = 100 - 75 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, items, k=10):
    docs = spark.createDataFrame(rows, DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.search(docs, "doc_id", "text", asked, "item_id", "text", k)
    return sorted((tuple(r) for r in found.select("item", "rank", "id", "score").collect()), key=str)


def search_rows():
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "ABC", "a-b", "x_y", "数学"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 80))) for _ in range(150)]
    texts += texts[:30] + [None, "", "!!", "w1 " * 3000]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30)))) for i in range(25)]
    items += [(3, items[3][1]), (3, "another text w2"), (90, None), (91, ""), (92, "unheard of"), (None, "w1 w1 w1")]
    rows = rows_of(texts)
    return rows + [rows[4], (None, *rows[5][1:]), (None, *rows[5][1:])], items


def test_search_equals_plain_scores(spark):
    rows, items = search_rows()
    assert searched(spark, rows, items) == plain_search(rows, items)


def test_search_in_small_tiles_and_blocks(spark, monkeypatch):
    """Ties over tiles, partial sums over vocabulary tiles, several blocks of items, texts in parts."""
    rows, items = search_rows()
    for name, value in (("ITEMS", 4), ("DOCS", 7), ("TERMS", 5), ("BLOCK_BYTES", 900), ("_CHUNK", 50)):
        monkeypatch.setattr(ranked_search, name, value)
    assert searched(spark, rows, items, 3) == plain_search(rows, items, 3)


def test_tiles_stay_exact():
    """Column sums of a tile stay at the limit; large weights are split; nothing is lost."""
    rnd = np.random.default_rng(2)
    entries = rnd.integers(0, 50, (40, 6)) * (rnd.random((40, 6)) < 0.4)
    entries[7, 2] = 1000
    total = np.zeros_like(entries)
    for rows, weights in ranked_search.vocabulary_tiles(entries, terms=9, limit=120):
        assert len(rows) <= 9 and weights.sum(axis=0).max() <= 120
        for r, w in zip(rows, weights):
            total[r] += w.astype(np.int64)
    assert (total == entries).all()
    limit = (ranked_search.EXACT - 1) // ranked_search.IMPACT
    (_, w), (_, v) = ranked_search.vocabulary_tiles(np.array([[2 * limit - 5]]))
    assert w.max() * ranked_search.IMPACT < 2**53 and int(w[0, 0]) + int(v[0, 0]) == 2 * limit - 5


def test_search_of_an_item_beyond_one_tile(spark):
    """A term repeated so often that its weight alone passes 2^53: scores stay whole."""
    rows = rows_of(["rare common", "common", "common x", "rare rare y"] + ["common z"] * 30)
    text = "rare " * 2_000_000 + "common"
    assert searched(spark, rows, [(1, text)]) == plain_search(rows, [(1, text)])


def test_search_of_empty_tables(spark):
    rows, items = search_rows()
    assert searched(spark, [], items) == [] == searched(spark, rows, [])
    assert searched(spark, rows_of([None, "", "..."]), items) == []
    with pytest.raises(ValueError):
        searched(spark, rows, items, 0)
