import numpy as np
import pandas as pd
import pytest

from ledgerwatch.functions.features import BASE_FEATURES
from ledgerwatch.operators import forest, leaf_boxes


def grown(rng, trees, rows, width):
    sample = rng.normal(size=(rows + trees, width)) * ([1, 0, 100, 5][:width])
    depth = forest.depth_limit(rows)
    nodes = [(0, t, *n) for t in range(trees) for n in forest._grow(sample[t : t + rows], depth, rng)]
    return (rows, *forest._heaps(pd.DataFrame(nodes, columns=forest._NODE_SCHEMA.names), depth))


@pytest.mark.parametrize("part, own, batch", [(1 << 13, 8, 1 << 17), (50, 8, 100), (50, 0, 1 << 17), (1, 8, 1), (300, 1e9, 1000)])
def test_parts_give_the_paths_of_a_walk(monkeypatch, part, own, batch):
    """Values on the splits, infinities and copies too; trees of too large a grid are walked."""
    rng = np.random.default_rng(5)
    forests = [grown(rng, 9, 64, 4), grown(rng, 4, 16, 4), grown(rng, 1, 1, 4)]
    x = rng.normal(size=(400, 4)) * [1, 1, 100, 5]
    x[:50, 0] = rng.choice(forests[0][2][(forests[0][1] == 0) & np.isfinite(forests[0][2])], 50)
    x[50], x[51], x[100:200] = np.inf, -np.inf, x[99]
    for name, value in (("PART", part), ("OWN_CELLS", own), ("BATCH", batch)):
        monkeypatch.setattr(leaf_boxes, name, value)
    got, seen = np.zeros((3, 400)), np.zeros(400, int)
    for rows, paths in leaf_boxes.LeafBoxes(forests, 4, forest._mean_path).mean_paths(x):
        got[:, rows] = paths
        seen[rows] += 1
    want = [forest._mean_path(x, *arrays) for _, *arrays in forests]
    assert (seen == 1).all() and np.abs(got - want).max() < 1e-12


def test_rows_close_together_are_not_walked():
    rng = np.random.default_rng(6)
    boxes = leaf_boxes.LeafBoxes([grown(rng, 20, 64, 3)], 3, None)
    assert sum(len(rows) for rows, _ in boxes.mean_paths(rng.uniform(0.5, 0.6, size=(20_000, 3)))) == 20_000


def test_the_search_scores_no_row_by_a_walk(frame, monkeypatch):
    """Blocks, copies, an infinity and rows without a feature: the variances are those of all scores."""
    rng = np.random.default_rng(7)
    rows = [(f"h{i}", *map(float, rng.lognormal(3, 1, 3))) for i in range(900)]
    rows += [(f"c{i}", 20.0, 21.0, 22.0) for i in range(300)] + [("n", None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0)]
    df = frame(rows, "hash string, value double, gas double, gas_price double").cache()
    fit, found = forest.fit_trials, []
    monkeypatch.setattr(forest, "fit_trials", lambda *a: found.append(fit(*a)) or found[-1])
    monkeypatch.setattr(forest, "score_many", None)
    table, best = forest.tune(df, trials=3)
    x = np.array([r[1:] for r in rows[:-2]])
    want = [np.var(forest.score_arrays(x, f.arrays)) for f in found[0]]
    got = table.orderBy("trial").collect()
    assert [r.score_variance for r in got] == pytest.approx(want, rel=1e-9)
    assert [r.is_best for r in got] == [v == max(want) for v in want] and best is found[0][int(np.argmax(want))]


def test_moments_do_not_depend_on_the_partitions(frame):
    rng = np.random.default_rng(8)
    df = frame([(f"h{i}", *map(float, rng.lognormal(3, 1, 3))) for i in range(500)], "hash string, value double, gas double, gas_price double")
    model = forest.fit(df, trees=5, threshold="none")
    one, other = (forest.score_moments(d.select(*BASE_FEATURES), [model]).first() for d in (df, df.repartition(3)))
    assert one.n == other.n == 500 and list(one)[2:] == pytest.approx(list(other)[2:], rel=1e-12)
