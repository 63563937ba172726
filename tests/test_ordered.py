"""Sliced per-key operators against plain Python, with every key hot and with none."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import monitor, ordered
from ledgerwatch.operators.buffer import live_by_severity, live_entries

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng, rows = random.Random(5), []
    for key, mean in (("hot", 30), ("mid", 900), (None, 4000)):
        t = 0.0
        for _ in range(400):
            t += rng.expovariate(1 / mean)
            rows.append((len(rows), key, BASE + timedelta(microseconds=int(t * 1e6)), float(rng.randint(0, 9))))
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v double").repartition(5).cache()
    by_key = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(row[1], []).append(row)
    return df, by_key


HOT = pytest.mark.parametrize("hot_rows", [1, 17, 10**6])


@HOT
def test_previous_and_running(log, hot_rows):
    df, by_key = log
    lagged = ordered.previous_values(df, ["k"], ["ts", "id"], ["v"], hot_rows)
    total = ordered.running_total(
        lagged, ["k"], ["ts", "id"], F.col("v"), "total", hot_rows)
    got = {r.id: (r.prev_v, r.total) for r in total.collect()}
    assert len(got) == 1200
    for rows in by_key.values():
        seen, prev = 0.0, None
        for i, _k, _t, v in rows:
            seen += v
            assert got[i] == (prev, seen)
            prev = v


@HOT
def test_preceding_rows_window(log, hot_rows):
    from pyspark.sql import Window

    df, by_key = log
    rows = ordered.with_preceding_rows(df, ["k"], ["ts", "id"], 4, ["v"], hot_rows)
    frame = Window.partitionBy("k", "_slice").orderBy("ts", "id").rowsBetween(-4, 0)
    got = {r.id: r.s for r in rows.withColumn("s", F.sum("v").over(frame)).where("not _halo").collect()}
    for group in by_key.values():
        for n, row in enumerate(group):
            assert got[row[0]] == sum(r[3] for r in group[max(0, n - 4): n + 1])


@HOT
def test_count_within(log, hot_rows):
    df, by_key = log
    got = {r.id: r.n for r in ordered.count_within(df, ["k"], "ts", 5000, "n", F.col("v") > 3, hot_rows).collect()}
    for group in by_key.values():
        for row in group:
            assert got[row[0]] == sum(
                1 for r in group if r[3] > 3 and timedelta(0) <= row[2] - r[2] <= timedelta(seconds=5000))


@HOT
def test_islands_across_slices(log, hot_rows):
    df, by_key = log
    got = sorted((r.k or "", r.start, r.end, r.n) for r in ordered.islands(
        df, ["k"], ["ts", "id"], "ts", F.col("v") > 1, hot_rows).collect())
    want = []
    for key, group in by_key.items():
        run = []
        for row in [*group, (None, None, None, -1.0)]:
            if row[3] > 1:
                run.append(row)
            elif run:
                want.append((key or "", run[0][2], run[-1][2], len(run)))
                run = []
    assert got == sorted(want)


def test_a_burst_is_cut_by_rows(spark):
    """99 % of a key at one time: no slice holds more than twice the wanted rows."""
    rows = [(i, "k", BASE + timedelta(seconds=0 if i < 9900 else i), 1.0) for i in range(10_000)] + [(10_000, "cold", BASE, 1.0)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v double").repartition(4)
    for keys in (["k"], []):
        sliced = ordered.with_row_slices(df, keys, ["ts", "id"], 100)
        sizes = [r.n for r in sliced.where("_slice is not null").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 200 and sum(sizes) == (10_000 if keys else 10_001)
        edges = sliced.where("_slice is not null").groupBy("_slice").agg(
            F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b")).orderBy("_slice").collect()
        assert all(tuple(x.b) < tuple(y.a) for x, y in zip(edges, edges[1:]))
    total = ordered.running_total(df, ["k"], ["ts", "id"], F.col("v"), "total", 100)
    assert sorted(r.total for r in total.where("k = 'k'").collect()) == [float(i) for i in range(1, 10_001)]
    counted = ordered.count_within(df, ["k"], "ts", 10, "n", hot_rows=100)
    got = {r.id: r.n for r in counted.collect()}
    assert got[0] == got[9899] == 9900 and got[9999] == 11 and got[10_000] == 1


def test_hot_keys_are_not_hinted(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("ts"))
    plan = ordered.running_total(df, ["k"], ["ts"], F.lit(1), "n", 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


def test_silence_without_events(frame):
    none = frame([], "k string, ts timestamp")
    hour = (BASE, BASE + timedelta(hours=1), 600)
    assert [r.silent_seconds for r in monitor.silent_periods(none, [], *hour).collect()] == [3600]
    expected = frame([("a",), ("b",)], "k string")
    got = monitor.silent_periods(none, ["k"], *hour, expected=expected).collect()
    assert sorted((r.k, r.silent_seconds) for r in got) == [("a", 3600), ("b", 3600)]
    some = frame([("a", BASE + timedelta(seconds=1800))], "k string, ts timestamp")
    got = monitor.silent_periods(some, ["k"], *hour, expected=expected).collect()
    assert sorted((r.k, r.silent_seconds) for r in got) == [("a", 1740), ("a", 1800), ("b", 3600)]


def test_fixed_window(frame):
    rows = [(i, "a", BASE + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 60))]
    audit = monitor.fixed_window_audit(frame(rows, "id int, ip string, ts timestamp"), ["ip"], 2, 60, hot_rows=1)
    got = [(r.allowed, r.retry_after) for r in audit.orderBy("id").collect()]
    assert got == [(True, 0), (True, 0), (False, 40), (True, 0)]


def test_silence(frame):
    at = (0, 60, 1800, 1860)
    events = frame([("a", BASE + timedelta(seconds=s)) for s in at], "k string, ts timestamp")
    got = monitor.silent_periods(events, ["k"], BASE, BASE + timedelta(hours=1), 600).orderBy("silent_from").collect()
    assert [(r.silent_seconds, r.silent_from) for r in got] == [
        (1680, BASE + timedelta(seconds=120)), (1680, BASE + timedelta(seconds=1920))]


def test_buffer_bounds(frame):
    rows = [(f"h{s}", BASE + timedelta(seconds=s), "low" if s % 2 else "high") for s in (-1, 0, 10, 3599, 3600)]
    entries = frame(rows, "tx_hash string, detected_at timestamp, severity string")
    now = BASE + timedelta(seconds=3600)
    assert [r.tx_hash for r in live_entries(entries, now).collect()] == ["h3600", "h3599", "h10", "h0"]
    assert [r.tx_hash for r in live_entries(entries, now, max_size=2, severity="high").collect()] == ["h3600"]
    per = live_by_severity(entries, now, 1).collect()
    assert sorted(r.tx_hash for r in per) == ["h3599", "h3600"]


def test_health_and_buckets(frame):
    metrics = frame([("cpu_percent", 95.0), ("disk_percent", 78.0), ("hit_rate", 10.0)], "m string, v double")
    row = monitor.health_report(metrics.withColumn("i", F.lit(1)), ["i"], "m", "v").first()
    assert (row.n_healthy, row.n_degraded, row.n_unhealthy, row.status) == (1, 1, 1, "unhealthy")
    df = frame([("a", x) for x in (0.05, 0.2, 0.2, 0.4, 9.0)], "k string, x double")
    buckets = monitor.bucket_counts(df, ["k"], "x", (0.1, 0.5, 1.0))
    assert monitor.bucket_quantile(buckets, ["k"], 0.5).first().quantile == pytest.approx(0.1 + 0.4 * 1.5 / 3)
    assert monitor.bucket_quantile(buckets, ["k"], 0.99).first().quantile == 1.0
