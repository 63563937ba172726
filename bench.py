"""Headline queries over the test tables; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS (timed runs at most; the
report gives each query's number),
BENCH_SMALL_DIR (a second, smaller folder; empty for none), BENCH_SECONDS (a query that has
used so many seconds is not repeated beyond two timed runs). Each query runs once to warm up
and is then timed; the median counts. Results go to the no-op sink, so all columns are
computed and nothing is collected. The messages of the stream are written before the clock
starts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerwatch.catalog import all_queries, streaming  # noqa: E402
from ledgerwatch.operators import forest  # noqa: E402
from ledgerwatch.session import local_session, new_path  # noqa: E402
from ledgerwatch.sources.kafka import read_lines  # noqa: E402
from ledgerwatch.sources.views import Views  # noqa: E402
from ledgerwatch.streaming import job  # noqa: E402
from ledgerwatch.streaming.parse import good_records  # noqa: E402

# Name in the report, registered query (none: the function of that name below), table whose rows it reads.
HEADLINES = (
    ("clean", "C4_clean", "tx_raw"),
    ("scale", "C6_min_max_scale", "tx"),
    ("stats", "G1_transaction_statistics", "tx"),
    ("label", "J2_label_by_anomaly", "tx"),
    ("ks", "K2_ks_statistic", "tx"),
    ("psi", "K4_psi", "tx"),
    ("drift", "K10_drift_report", "tx"),
    ("fit", None, "tx"),
    ("score", None, "tx"),
    ("detect", "M3_label_counts", "tx"),
    ("series", "W1_daily_series_per_address", "tx"),
    ("rolling", "O2_rolling_features", "tx"),
    ("rate", "P1_counter_rate", "events"),
    ("limits", "P8_named_limits", "events"),
    ("route", "R2_route_split", "events"),
    ("stream", None, "tx_raw"),
)


def fit(views: Views):
    """Trees and threshold."""
    from ledgerwatch.catalog.models import _tx

    return lambda: forest.fit(_tx(views))


def score(views: Views):
    """A fitted model of 100 trees; fitted before the clock starts."""
    from ledgerwatch.catalog.models import _tx

    model = forest.fit(_tx(views), threshold="none")
    return lambda: forest.score(_tx(views), model).write.format("noop").mode("overwrite").save()


def stream(views: Views):
    """Parse, remove repeats, score with a fitted model, store all sinks."""
    folder, spark = streaming.messages(views, 8), views.spark
    good = good_records(job.parsed(spark.read.text(folder), streaming._arrived()))
    model = forest.fit(good, job.STREAM_FEATURES)

    def run():
        scorer = job.BatchScorer(job.Paths(new_path(spark, "job")), model=model)
        job.start(read_lines(spark, folder, 4), scorer, "400 days", arrived=streaming._arrived()).awaitTermination()

    return run


def measure(spark, folder: str, runs: int, most: float) -> tuple[dict, dict, dict, dict]:
    views = Views(spark, folder)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    rows = {"events": events, "tx_raw": events + events // 10, "tx": spark.read.parquet(f"{folder}/lineitem.parquet").count()}
    queries, seconds, cold, timed = all_queries(), {}, {}, {}
    for name, key, _table in HEADLINES:
        act = {"fit": fit, "score": score, "stream": stream}[name](views) if key is None else (
            lambda key=key: queries[key](spark, folder).write.format("noop").mode("overwrite").save())
        taken = []
        for run in range(runs + 1):
            if run > 2 and sum(taken[1:]) > most:
                break
            begin = time.perf_counter()
            act()
            taken.append(time.perf_counter() - begin)
        cold[name] = round(taken[0], 3)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        timed[name] = len(taken) - 1
    return seconds, cold, timed, {n: round(rows[t] / seconds[n]) for n, _k, t in HEADLINES}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs, most = int(os.environ.get("BENCH_RUNS", "5")), float(os.environ.get("BENCH_SECONDS", "15"))
    spark = local_session(cpus, "bench")
    seconds, cold, timed, speed = measure(spark, folder, runs, most)
    report = {
        "metric": "total seconds of the headline queries (median warm run each)",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "cold": cold, "rows_per_sec": speed, "runs": timed,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }
    if small and os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(folder):
        report["small"] = {"sf": os.path.basename(small.rstrip("/")).removeprefix("sf"), "queries": measure(spark, small, runs, most)[0]}
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
