"""What may not grow with the tables: sizes of parts, passes over joins, work on finished series."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch import catalog
from ledgerwatch.operators import forest, joins, likelihood, ordered, prefix
from ledgerwatch.sources import tables

ORDERS = "o_orderkey long, o_custkey long, o_totalprice double"
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_shipdate timestamp, l_extendedprice double, "
         "l_quantity double, l_discount double, l_linestatus string, l_returnflag string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(5)
    orders = [(i, i % 40, float(rng.uniform(1e3, 1e5))) for i in range(300)]
    lines = [(i % 300, i % 70, i % 9, i // 300 + 1, datetime(1996, 1, 1) + timedelta(days=int(rng.integers(0, 900))), float(rng.uniform(9e2, 1e5)),
              float(rng.integers(1, 51)), 0.05, "FO"[i % 2], "R") for i in range(1200)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return at


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_follow_the_input(spark, folder, tmp_path):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert tables.buckets_for(lines) == 8
    few, many = tables.buckets_for(lines, 1, 4096), tables.buckets_for(lines, 1, 1024)
    assert 1 < few and 3 * few < many
    assert tables.buckets_for(spark.createDataFrame([(1,)], "a int"), 3) == 3


def test_files_of_a_lookup_table_follow_the_input(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 1024)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    tables.write_lookup(lines, str(tmp_path / "t"), "year", "l_shipdate", ["l_orderkey"], "l_orderkey", 100, files=2)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 1200 and len(stored.inputFiles()) > 8


@pytest.mark.parametrize("name", ["A7_insert_into_buckets", "J1_anomaly_with_bucketed_transaction"])
def test_bucketed_queries_take_more_buckets_for_more_input(spark, folder, monkeypatch, name):
    found, save = [], tables.save_bucketed

    def noted(tx, table, path, buckets, key="hash"):
        found.append(buckets)
        return save(tx, table, path, buckets, key)

    monkeypatch.setattr(tables, "save_bucketed", noted)
    monkeypatch.setattr(tables, "parts_by_bytes", lambda df, part_bytes, least=1: max(least, 11))
    assert catalog.all_queries()[name](spark, folder).count() > 0 and found == [11]


def test_batches_of_hashes_that_repeat(spark, tmp_path, monkeypatch):
    """Of a repeated hash the earliest row counts, one without time before all; in one round or several."""
    days = [None, datetime(1995, 5, 1), datetime(1995, 6, 1), datetime(1996, 1, 1), datetime(1997, 1, 1)]
    rng = np.random.default_rng(3)
    lines = [(k, k, 1, 1, days[int(rng.integers(0, 5))], 1.0, 1.0, 0.05, "F", "R") for k in range(80) for _ in range(1 + k % 3)]
    spark.createDataFrame([(k, 1, 4.0) for k in range(80)], ORDERS).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    first = {}
    for k, *_, at in (r[:5] for r in lines):
        first[k] = min(first.get(k, datetime.max), at or datetime.min)
    inserted = sum(not datetime.min < at < datetime(1996, 1, 1) for at in first.values())
    assert 0 < inserted < 80
    for at_most in (tables.ROUND_BUCKETS, 3):
        monkeypatch.setattr(tables, "ROUND_BUCKETS", at_most)
        assert tuple(catalog.all_queries()["A7_insert_into_buckets"](spark, str(tmp_path)).first()) == (inserted, 80, 80)


def test_the_quantile_of_a_column_joins_once(spark, folder, monkeypatch):
    plans, exact = [], prefix.exact_quantile

    def noted(df, *rest):
        plans.append(optimized(df))
        return exact(df, *rest)

    monkeypatch.setattr(prefix, "exact_quantile", noted)
    got = catalog.all_queries()["W3_quantile_of_a_column"](spark, folder).first()
    values = [r.l_extendedprice for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect()]
    assert list(got) == pytest.approx([round(float(np.quantile(values, s)), 6) for s in (0.37, 0.995)])
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_predictions_join_the_tables_once(spark, folder, monkeypatch):
    plans, missing, fit = [], joins.predict_missing, forest.fit
    monkeypatch.setattr(joins, "predict_missing", lambda tx, *rest: plans.append(optimized(tx)) or missing(tx, *rest))
    monkeypatch.setattr(forest, "fit", lambda tx, *rest: plans.append(optimized(tx)) or fit(tx, *rest))
    rows = catalog.all_queries()["M6_batch_predict"](spark, folder)
    assert rows.select("hash").distinct().count() == rows.count() == 1200
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_nothing_is_drawn_without_a_hot_key(frame):
    rows = frame([(k, i) for k in ("a", "b", None) for i in range(20)], "k string, t int")
    cold = ordered.with_preceding_rows(rows, ["k"], ["t"], 2, ["t"], 20)
    assert not any(w in optimized(cold) for w in ("Join", "Union", "Aggregate")) and cold.count() == 60
    assert ordered.with_row_slices(rows, ["k"], ["t"], 10).select("_slice").distinct().count() > 1


def test_positions_in_a_hash_order(frame):
    rows = frame([(f"k{i % 400}" if i % 7 else None, i) for i in range(900)], "k string, i int")
    at = F.pmod(F.xxhash64("k"), F.lit(1000)) / 1000.0
    want = {r.n: (r.h, r.k) for r in ordered.row_numbers(rows.withColumn("h", at), [], ["h", "k"], "n").collect()}
    for hot_rows in (50, 10_000):
        numbered = ordered.hashed_row_numbers(rows, at, "k", "n", hot_rows).withColumn("h", at).collect()
        assert {r.n: (r.h, r.k) for r in numbered} == want and sorted(want) == list(range(1, 901))


def test_importance_searches_for_no_cuts(spark, folder, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a hash order needs no cuts")

    monkeypatch.setattr(ordered, "with_row_slices", never)
    found = {r.feature: r.matters for r in catalog.all_queries()["O3_importance_of_fixed_model"](spark, folder).collect()}
    assert found == {"value": True, "gas": True, "gas_price": False}


def test_finished_series_are_left_out_of_the_search(monkeypatch):
    sizes, filtered = [], likelihood.filtered
    monkeypatch.setattr(likelihood, "filtered", lambda w, *rest: sizes.append(len(w)) or filtered(w, *rest))
    rng = np.random.default_rng(2)
    series = [rng.normal(size=int(n)) for n in rng.integers(12, 60, 30)]
    starts = [(np.array([0.1]), np.array([0.2]))] * len(series)
    together = likelihood.maximised(series, starts)
    tried = [n // likelihood.TRIED for n in sizes if n % likelihood.TRIED == 0]
    assert min(tried) < 15 < max(tried)
    for one, found in zip(series, together):
        alone = likelihood.maximised([one], starts[:1])[0]
        assert found["loglik"] == pytest.approx(alone["loglik"], abs=1e-6) and found["loglik"] >= found["start_loglik"]


@pytest.mark.parametrize("limit", [1 << 17, 40])
def test_cells_give_the_scores_of_a_walk(monkeypatch, limit):
    """To the last bit, for values on the splits and beyond; trees of too many cells are walked."""
    import pandas as pd

    rng = np.random.default_rng(8)
    sample = rng.normal(size=(64, 3)) * [1, 0, 100]
    nodes = pd.DataFrame([(0, t, *n) for t in range(9) for n in forest._grow(sample[t:], 6, rng)], columns=forest._NODE_SCHEMA.names)
    arrays = (64, *forest._heaps(nodes, 6))
    x, other = rng.normal(size=(500, 3)) * [1, 1, 100], rng.normal(size=(500, 3)) * [1, 1, 100]
    x[:50, 0] = rng.choice(arrays[2][(arrays[1] == 0) & np.isfinite(arrays[2])], 50)
    x[50], x[51], x[52] = np.inf, -np.inf, np.nan
    monkeypatch.setattr(forest, "CELLS", limit)
    found = forest.Cells(arrays).moved_scores(x, other)
    for f, got in enumerate(found):
        want = x.copy()
        if f:
            want[:, f - 1] = other[:, f - 1]
        assert np.array_equal(got, forest.score_arrays(want, arrays))


def test_the_walk_is_not_repeated_for_every_feature(monkeypatch):
    """Blocks are scored from tables: no walk after these are made."""
    arrays = (4, np.array([[0, 1, 0]], np.int32), np.array([[3.0, 4.0, 6.0]]), np.array([[1.5, 2.0, 3.0, 1.0]]))
    cells = forest.Cells(arrays)
    monkeypatch.setattr(forest, "_mean_path", None)
    assert len(cells.moved_scores(np.ones((5, 2)), np.full((5, 2), 9.0))) == 3
