import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import forest
from ledgerwatch.sources.kafka import kafka_options, read_lines
from ledgerwatch.streaming import job
from ledgerwatch.streaming.parse import good_records

ARRIVED = "2024-02-01"


def write_messages(path, start, count, files=1, bad_every=0):
    path.mkdir(exist_ok=True)
    rng = np.random.default_rng(start)
    for f in range(files):
        lines = []
        for i in range(start + f * count, start + (f + 1) * count):
            record = {"hash": f"0x{i}", "value": str(rng.lognormal(8, 1)), "gas": "21000",
                      "gasPrice": str(rng.integers(1, 100)), "timestamp": str(datetime(2024, 1, 1) + timedelta(seconds=i))}
            if bad_every and i % bad_every == 0:
                record["value"] = "invalid"
            lines.append(json.dumps(record))
            if i % 7 == 0:
                lines.append(json.dumps(record))
        lines.append("not json")
        (path / f"part-{start:06d}-{f}.txt").write_text("\n".join(lines) + "\n")


def run(spark, source, root, max_files, **scorer):
    paths = job.Paths(str(root))
    running = job.start(
        read_lines(spark, str(source), max_files), job.BatchScorer(paths, **scorer), "30 days",
        arrived=F.lit(ARRIVED).cast("timestamp"),
    )
    running.awaitTermination()
    return paths, running


@pytest.mark.parametrize("max_files", [1, 3, None])
def test_stream_equals_batch(spark, tmp_path, max_files):
    write_messages(tmp_path / "in", 0, 100, files=5, bad_every=10)
    batch = good_records(job.parsed(spark.read.text(str(tmp_path / "in")), F.lit(ARRIVED).cast("timestamp")))
    unique = batch.dropDuplicates(["hash"])
    model = forest.fit(unique, job.STREAM_FEATURES)
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", max_files, model=model)
    got = {(r.hash, r.anomaly) for r in spark.read.parquet(paths.predictions).collect()}
    want = {(r.hash, r.anomaly) for r in forest.detect(unique, model).collect()}
    assert got == want and len(got) == 450
    rejects = spark.read.parquet(paths.rejects)
    assert {r.reason for r in rejects.collect()} == {"invalid value", "missing hash"}
    anomalies = spark.read.parquet(paths.anomalies)
    assert {r.hash for r in anomalies.collect()} == {h for h, label in want if label == "anomaly"}
    assert anomalies.where("severity is null or detected_at is null").count() == 0


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    write_messages(tmp_path / "in", 0, 300)
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", 1)
    first = spark.read.parquet(paths.predictions).count()
    write_messages(tmp_path / "in", 250, 200)
    paths, running = run(spark, tmp_path / "in", tmp_path / "job", 1)
    rows = spark.read.parquet(paths.predictions)
    assert first == 300
    assert rows.count() == rows.select("hash").distinct().count() == 450
    status = {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect()}
    assert status["processed_success"] == 450


def test_early_rows_wait_and_are_scored_later(spark, tmp_path):
    write_messages(tmp_path / "in", 0, 100)
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", 1)
    assert {r.anomaly for r in spark.read.parquet(paths.predictions).collect()} == {"unscored"}
    write_messages(tmp_path / "in", 100, 60)
    run(spark, tmp_path / "in", tmp_path / "job", 1)
    write_messages(tmp_path / "in", 160, 340)
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", 1)
    rows = spark.read.parquet(paths.predictions)
    assert {r.anomaly for r in rows.collect()} == {"normal", "anomaly"}
    assert rows.count() == rows.select("hash").distinct().count() == 500
    assert not job.path_exists(spark, paths.waiting)
    model = forest.load(spark, paths.model)
    assert model.features == job.STREAM_FEATURES
    status = {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect()}
    assert status["anomalies_detected"] == rows.where("is_anomaly").count() == spark.read.parquet(paths.anomalies).count() > 0
    assert status["processed_success"] == 500 and status["batches"] >= 3


def test_equal_bad_records_all_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"hash": "0x1", "value": "1", "gas": "2", "gasPrice": "3"})
    (tmp_path / "in" / "a.txt").write_text("\n".join(["broken"] * 5 + [good] * 3) + "\n")
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", None)
    assert spark.read.parquet(paths.rejects).count() == 5
    status = {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect()}
    assert (status["processed_error"], status["processed_success"], status["input_rows"]) == (5, 1, 6)


def test_status_remembers_all_batches(spark, tmp_path):
    """More batches than a progress list keeps."""
    paths = job.Paths(str(tmp_path / "job"))
    rows = [(k, name, value) for k in range(150) for name, value in
            (("processed_success", 2.0), ("processed_error", 1.0), ("batches", 1.0), ("batch_millis", float(k)))]
    df = spark.createDataFrame(rows, "batch_id int, metric_name string, metric_value double").withColumn("timestamp", F.current_timestamp())
    df.write.partitionBy("batch_id").parquet(paths.metrics)
    status = {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect()}
    assert status == {"processed_success": 300, "processed_error": 150, "batches": 150, "input_rows": 450, "slowest_batch_millis": 149}


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "sink")
    for k in range(5):
        job.write_batch(spark.range(k * 10, k * 10 + 10), path, k)
    assert job.compact(spark, path, 3) == 4
    rows = spark.read.parquet(path)
    assert sorted(r.id for r in rows.collect()) == list(range(50))
    assert {r.batch_id for r in rows.select("batch_id").distinct().collect()} == {-1, 4}
    assert job.compact(spark, path, 3) == 0


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    write_messages(tmp_path / "in", 0, 300)
    paths = job.Paths(str(tmp_path / "job"))
    scorer = job.BatchScorer(paths)
    batch = job.parsed(spark.read.text(str(tmp_path / "in")), F.lit(ARRIVED).cast("timestamp"))
    batch = job.unique_good(batch, "1 day")
    scorer(batch, 0)
    scorer(batch, 0)
    assert spark.read.parquet(paths.predictions).count() == 300


def test_own_scoring_function(spark, tmp_path):
    write_messages(tmp_path / "in", 0, 50)

    def rule(df):
        score = -F.col("value") / 1e6
        return df.withColumns({
            "anomaly_score": score, "confidence": F.abs(score),
            "anomaly": F.when(F.col("value") > 3000, "anomaly").otherwise("normal")})

    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", None, score_fn=rule)
    rows = spark.read.parquet(paths.predictions)
    assert rows.where("is_anomaly != (value > 3000)").count() == 0 and rows.count() == 50


def test_kafka_options_and_lag():
    options = kafka_options("h:9092", "tx", start="earliest", max_per_trigger=500)
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "500"
    for bad in ({"start": "middle"}, {"max_per_trigger": 0}, {"topic": ""}):
        with pytest.raises(ValueError):
            kafka_options(**({"servers": "h:1", "topic": "t"} | bad))
    progress = {"sources": [{"endOffset": {"tx": {"0": 100}}, "latestOffset": '{"tx": {"0": 150, "1": 7}}'}]}
    assert sorted(job.kafka_offsets(progress)) == [("tx", 0, 100, 150), ("tx", 1, 0, 7)]


def test_a_short_stream_is_scored_when_it_ends(spark, tmp_path):
    """100 good rows, fewer than a model asks for on the way."""
    write_messages(tmp_path / "in", 0, 25, files=4)
    paths = job.Paths(str(tmp_path / "job"))
    how = {"arrived": F.lit(ARRIVED).cast("timestamp")}
    job.drain(read_lines(spark, str(tmp_path / "in"), 1), job.BatchScorer(paths), "30 days", **how)
    rows = job.commits.read(spark, paths.predictions)
    assert rows.count() == rows.select("hash").distinct().count() == 100
    assert {r.anomaly for r in rows.collect()} <= {"normal", "anomaly"}
    assert not job.path_exists(spark, paths.waiting) and forest.load(spark, paths.model).features == job.STREAM_FEATURES
    write_messages(tmp_path / "in", 100, 30)
    job.drain(read_lines(spark, str(tmp_path / "in"), 1), job.BatchScorer(paths), "30 days", **how)
    rows = job.commits.read(spark, paths.predictions)
    assert rows.count() == 130 and rows.where("anomaly = 'unscored'").count() == 0
    reports = job.progress_table(spark, paths).where("input_rows > 0").collect()
    assert sum(r.good for r in reports) == 130 and sum(r.bad for r in reports) == 5
    assert len({r.batch_id for r in reports}) == len(reports) >= 5 and all(r.millis > 0 and r.lag == 0 for r in reports)


def test_finish_may_be_ended_and_run_again(spark, tmp_path, monkeypatch):
    write_messages(tmp_path / "in", 0, 40, files=2)
    paths, _ = run(spark, tmp_path / "in", tmp_path / "job", 1)
    scorer = job.BatchScorer(paths)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(job.commits, "drop", lost)
        with pytest.raises(RuntimeError):
            scorer.finish(spark)
    assert job.BatchScorer(paths).finish(spark) == 80 and job.BatchScorer(paths).finish(spark) == 0
    rows = job.commits.read(spark, paths.predictions)
    assert rows.count() == 80 and rows.where("anomaly = 'unscored'").count() == 0
    status = {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect()}
    assert status["anomalies_detected"] == rows.where("is_anomaly").count()


def test_status_after_a_replayed_batch(spark, tmp_path):
    """The batch that fits the model also scores those before it; run again, the totals stay."""
    paths = job.Paths(str(tmp_path / "job"))
    scorer, batches = job.BatchScorer(paths, min_training_rows=150, contamination=0.1), []
    for k in range(2):
        write_messages(tmp_path / f"in{k}", k * 100, 100)
        parsed = job.parsed(spark.read.text(str(tmp_path / f"in{k}")), F.lit(ARRIVED).cast("timestamp"))
        batches.append(job.unique_good(parsed, "1 day"))
        scorer(batches[k], k)

    def status():
        return {r.metric_name: r.metric_value for r in job.status_table(spark, paths).collect() if "millis" not in r.metric_name}

    first = status()
    assert first["anomalies_detected"] == job.commits.read(spark, paths.anomalies).count() > 0
    for again in (scorer, job.BatchScorer(paths, min_training_rows=150, contamination=0.1)):
        again(batches[1], 1)
        assert status() == first
    assert job.commits.read(spark, paths.predictions).count() == 200


def test_live_state_equals_the_batch_view(spark, tmp_path):
    """Bounded per severity, evicted in time, the same over a restart."""
    from ledgerwatch.operators.buffer import live_by_severity
    from ledgerwatch.streaming import live

    rng, schema = np.random.default_rng(5), "tx_hash string, severity string, detected_at timestamp, anomaly_score double"
    start, folder, seen = datetime(2024, 1, 1), str(tmp_path / "in"), []
    for turn, step in enumerate((0, 100, 200, 900)):
        rows = [(f"h{turn}-{i}", str(rng.choice(["low", "low", "low", "high"])) if i % 9 else None,
                 start + timedelta(seconds=int(step + rng.integers(150))), float(i)) for i in range(50)]
        rows = rows[: 3 if turn == 3 else None]
        spark.createDataFrame(rows + rows[:2] + [(None, "low", start, 0.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        if turn == 0:
            continue  # the first run has two files
        entries = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        live.keep_live(entries, str(tmp_path / "changes"), str(tmp_path / "offsets"), 10, 120).awaitTermination()
        stored = spark.read.parquet(folder).where("tx_hash is not null").distinct()
        now = stored.agg(F.max("detected_at").alias("t")).first()["t"]
        want = {(r.severity, r.tx_hash, r.detected_at) for r in live_by_severity(stored, now, 10, 120).collect()}
        view = live.live_view(spark, str(tmp_path / "offsets"))
        assert {(r.severity, r.key, r.inserted_at) for r in view.collect()} == want
        changes = live.view_of_changes(job.commits.read(spark, str(tmp_path / "changes")))
        assert {(r.severity, r.key, r.inserted_at) for r in changes.collect()} == want
        assert json.loads(view.first()["payload"]).keys() == {"anomaly_score"}
        seen.append(len(want))
    assert seen[0] > 20 and seen[-1] == 3  # the last files come long after: the old entries are gone
