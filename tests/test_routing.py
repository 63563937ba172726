from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import routing

def versions(frame, *rows):
    return frame(list(rows), "id int, model_id int, version string, is_deployed boolean, "
                             "traffic_percentage double, created_seq int")


def test_routes(frame, spark):
    users = spark.range(2000).select(
        "id", F.col("id").cast("string").alias("user_id"), F.lit(1).alias("model_id"))
    two = versions(frame, (1, 1, "a", True, 70.0, 1), (2, 1, "b", True, 20.0, 2), (3, 1, "c", False, 100.0, 3))
    routed = routing.route(users, two)
    share = {r.version_id: r.n / 2000 for r in routed.groupBy("version_id").agg(F.count("*").alias("n")).collect()}
    assert share[1] == pytest.approx(0.7, abs=0.04) and share[2] == pytest.approx(0.2, abs=0.04)
    assert share[None] == pytest.approx(0.1, abs=0.04)
    again = routing.route(users.repartition(3), two)
    assert routed.exceptAll(again).count() == 0
    fixed = routing.route(users, two, "reference").select("version_id").distinct().collect()
    assert [r.version_id for r in fixed] == [1]
    single = versions(frame, (1, 1, "a", True, 30.0, 1))
    part = routing.route(users, single, "reference").where("version_id is not null")
    assert part.count() / 2000 == pytest.approx(0.3, abs=0.04)
    with pytest.raises(ValueError):
        routing.route(users, single, "other")


@pytest.mark.parametrize("deployed, traffic, share", [(True, 0.0, 0), (True, 100.0, 1), (False, 100.0, 0), (True, 50.0, .5)])
def test_one_version(frame, spark, deployed, traffic, share):
    users = spark.range(1000).select("id", F.col("id").cast("string").alias("user_id"))
    decided = routing.with_version_decision(users, versions(frame, (9, 1, "a", deployed, traffic, 1)), 9)
    assert decided.where("use_version").count() / 1000 == pytest.approx(share, abs=0.05)


def test_ranges_with_fractions_follow_the_traffic(frame):
    rows = [(i, 1, "v", True, t, i) for i, t in enumerate((10.5, 11.0, 11.0, 10.9, 0.4, 30.0))]
    got = [(r.version_id, r.rank, round(r.until, 6)) for r in
           routing.ranked_versions(versions(frame, *rows)).orderBy("rank").collect()]
    assert got == [(5, 1, 30.0), (1, 2, 41.0), (2, 3, 52.0), (3, 4, 62.9), (0, 5, 73.4), (4, 6, 73.8)]


def test_winner(frame):
    now = datetime(2024, 1, 2)
    schema = "model_version_id int, detected_at timestamp, confidence double, anomaly_score double, severity string"

    def compare(a, b):
        rows = [(1, now, c, -c, s) for c, s in a] + [(2, now, c, -c, s) for c, s in b]
        return routing.compare_versions(frame(rows, schema), 1, 2, now).first().winner

    assert compare([(0.9, "low")], [(0.8, "critical")]) == "model_a"
    assert compare([(0.80, "low")], [(0.82, "critical")]) == "model_b"
    assert compare([(0.8, "low")] * 3, [(0.8, "low")]) == "model_a"
    assert compare([(0.8, "low")], [(0.8, "low")]) == "tie"
    assert compare([], [(0.8, "low")]) == "model_b"
