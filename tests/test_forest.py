import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions.features import BASE_FEATURES
from ledgerwatch.operators import forest


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(42)
    rows = [(f"0x{i:05d}", float(rng.lognormal(10, 2) % 1e6), float(rng.integers(21000, 100000)),
             float(rng.lognormal(3, 1)), False) for i in range(1900)]
    rows += [(f"0y{i:05d}", float(rng.uniform(1e9, 1e12)), float(rng.uniform(1e5, 1e6)),
              float(rng.uniform(100, 10000)), True) for i in range(100)]
    return spark.createDataFrame(
        rows, "hash string, value double, gas double, gas_price double, planted boolean").cache()


def test_parameters():
    for bad, kind in ((0, ValueError), (1, ValueError), ("a", TypeError), (True, TypeError)):
        with pytest.raises(kind):
            forest.check_parameters(bad, 1)
    with pytest.raises(TypeError):
        forest.check_parameters(0.1, 1.5)


def test_planted_outliers_and_rate(planted):
    model = forest.fit(planted, contamination=0.05)
    found = forest.detect(planted, model)
    low = [r.planted for r in found.orderBy("anomaly_score").limit(100).collect()]
    assert sum(low) >= 90
    rate = forest.only_anomalies(found).count() / 2000
    assert rate == pytest.approx(0.05, abs=0.002)
    row = found.agg(F.min("anomaly_score").alias("a"), F.max("anomaly_score").alias("b")).first()
    assert -1 <= row.a < row.b < 0


def test_same_seed_same_model_whatever_the_partitions(planted):
    a = forest.fit(planted, threshold="none")
    b = forest.fit(planted.repartition(3), threshold="none")
    c = forest.fit(planted, seed=7, threshold="none")
    assert a.checksum == b.checksum != c.checksum


def test_constant_features_and_tiny_tables(frame):
    rows = [(f"h{i}", v, 21000.0, 50.0) for i, v in enumerate((100.0, 200.0, 150.0, 0.0, 500.0, 600.0, 700.0))]
    df = frame(rows, "hash string, value double, gas double, gas_price double")
    labels = {r.anomaly for r in forest.detect(df, forest.fit(df)).collect()}
    assert labels <= {"normal", "anomaly"}
    with pytest.raises(ValueError):
        forest.fit(df.where("value < 0"))
    with pytest.raises(ValueError, match="gas_price"):
        forest.fit(df.drop("gas_price"))


def test_walk_equals_recursive_definition(planted):
    nodes = forest.tree_nodes(planted, BASE_FEATURES, [forest.Spec(5, 64)], 1, "hash", 2000).toPandas()
    depth = forest.depth_limit(64)
    heaps = forest._heaps(nodes, depth)
    x = planted.limit(50).select(*BASE_FEATURES).toPandas().to_numpy()
    lookup = {(n.tree, n.node): n for n in nodes.itertuples()}

    def walk(tree, row):
        at = 0
        while lookup[tree, at].feature >= 0:
            n = lookup[tree, at]
            at = 2 * at + 1 if row[n.feature] <= n.threshold else 2 * at + 2
        return lookup[tree, at].path

    want = [np.mean([walk(t, row) for t in range(5)]) for row in x]
    assert forest._mean_path(x, *heaps) == pytest.approx(want)
    assert nodes[nodes.node == 0]["size"].tolist() == [64] * 5


def test_save_load_and_tampering(spark, planted, tmp_path):
    model = forest.fit(planted)
    path = str(tmp_path / "model")
    assert forest.save(spark, model, path) == model.checksum == forest.load(spark, path).checksum
    spark.read.parquet(f"{path}/nodes").withColumn("path", F.col("path") + 1).coalesce(1).write.parquet(
        f"{path}2/nodes")
    spark.read.parquet(f"{path}/meta").write.parquet(f"{path}2/meta")
    with pytest.raises(ValueError, match="checksum"):
        forest.load(spark, f"{path}2")


def test_save_and_load_without_arrow(spark, planted, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        model = forest.fit(planted)
        forest.save(spark, model, str(tmp_path / "plain"))
        again = forest.load(spark, str(tmp_path / "plain"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert again.checksum == model.checksum and again.threshold == model.threshold


def test_fit_detect_equals_fit_and_detect(planted):
    model, found = forest.fit_detect(planted, contamination=0.03)
    assert model.threshold == forest.fit(planted, contamination=0.03).threshold
    assert found.select("hash", "anomaly").exceptAll(forest.detect(planted, model).select("hash", "anomaly")).count() == 0
    assert found.columns == [*planted.columns, "anomaly_score", "confidence", "anomaly"]


def test_one_sampling_rule(planted):
    """A tree's rows do not depend on the other trials of the same pass."""
    alone = forest.tree_nodes(planted, BASE_FEATURES, [forest.Spec(3, 32)], 1, "hash", 2000).toPandas()
    assert alone[alone.node == 0]["size"].tolist() == [32] * 3


def test_null_feature_gives_null_score(frame, planted):
    model = forest.fit(planted)
    df = frame([("a", None, 1.0, 1.0)], "hash string, value double, gas double, gas_price double")
    assert forest.score(df, model).first().anomaly_score is None


def test_the_walk_runs_once_under_a_filter(planted):
    scored = forest.score(planted, forest.fit(planted, threshold="none"))
    plan = scored.where("anomaly_score < -0.5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tune_and_importance(planted):
    table, best = forest.tune(planted, trials=3)
    rows = table.collect()
    top = max(rows, key=lambda r: r.score_variance)
    assert [r.trial for r in rows if r.is_best] == [top.trial] and best.trees == top.n_estimators
    importance = {r.feature: r.importance for r in forest.permutation_importance(planted, best).collect()}
    assert set(importance) == set(BASE_FEATURES) and all(v > 0 for v in importance.values())


def test_trees_draw_by_a_compiled_join_as_they_drew_before(spark):
    at = F.col("id")
    rows = spark.range(5000).select(
        F.concat(F.lit("h"), at.cast("string")).alias("hash"),
        (at * 37 % 101).cast("double").alias("a"), (at * 53 % 211).cast("double").alias("b"))
    specs = [forest.Spec(3, 16), forest.Spec(2, 32)]
    nodes = forest.tree_nodes(rows, ["a", "b"], specs, 5, "hash", 5000)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" in plan and "lambda" not in plan.split("NestedLoopJoin")[0]
    roots = [(int(r["trial"]), int(r["tree"]), r["feature"], round(r["threshold"], 6))
             for r in nodes.where("node = 0").orderBy("trial", "tree").collect()]
    # What the draw by a lambda over all trees gave.
    assert roots == [(0, 0, 1, 171.164336), (0, 1, 1, 83.856702), (0, 2, 0, 38.36313), (1, 0, 0, 47.130823), (1, 1, 1, 112.534215)]
