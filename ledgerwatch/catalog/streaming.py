"""Queries that run as streams over files written from the test data."""

from pyspark.sql import functions as F

from ledgerwatch.catalog.cleaning import _REASON
from ledgerwatch.catalog.registry import query
from ledgerwatch.functions.numeric import unix_timestamp
from ledgerwatch.operators import forest
from ledgerwatch.session import new_path
from ledgerwatch.sources import commits
from ledgerwatch.sources.kafka import read_lines
from ledgerwatch.sources.views import VIEW_SQL
from ledgerwatch.streaming import job, live
from ledgerwatch.streaming.parse import good_records, rejected_records

def _arrived():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


_LONG = "400 days"


def messages(v, files: int = 6) -> str:
    """The raw transactions as JSON lines in a new folder."""
    path = new_path(v.spark, "messages")
    _lines(v).repartition(files).write.text(path)
    return path


def _lines(v):
    record = F.struct(
        "hash", "value", "gas", F.col("gas_price").alias("gasPrice"), F.col("from_address").alias("from"),
        F.date_format(unix_timestamp(F.col("time_stamp")), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
    return v.tx_raw.select(F.to_json(record).alias("value"))


def _drain(stream, label: str):
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, "offsets")
    running = job.append_to(stream, path, checkpoint)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("T1_good_records", f"""
    select hash, try_cast(value as double) as value, try_cast(gas as double) as gas,
           try_cast(gas_price as double) as "gasPrice", from_address as "from",
           coalesce(make_timestamp(try_cast(time_stamp as bigint) * 1000000), timestamp '2024-02-01')
               as timestamp
    from tx_raw where {_REASON} is null""")
def _(v):
    stream = job.parsed(read_lines(v.spark, messages(v), 2), _arrived())
    return _drain(good_records(stream), "good").select(
        "hash", "value", "gas", "gasPrice", "from", "timestamp")


@query("T1_rejected_records", f"""
    select reason, count(*) as n from (select {_REASON} as reason from tx_raw)
    where reason is not null group by reason""")
def _(v):
    stream = job.parsed(read_lines(v.spark, messages(v), 2), _arrived())
    return _drain(rejected_records(stream), "bad").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _batches(v, files: int, at_once: int):
    """Rows and number of micro-batches of a bounded run, from what it stored."""
    spark, path = v.spark, new_path(v.spark, "lines")
    running = job.append_batches(
        read_lines(spark, messages(v, files), at_once), lambda df, k: job.write_batch(df, path, k), new_path(spark, "offsets"))
    running.awaitTermination()
    return commits.read(spark, path).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("batches"))


@query("A5_bounded_run", "select count(*) as rows, cast(3 as bigint) as batches from tx_raw")
def _(v):
    return _batches(v, 6, 2)


@query("T9_unique_hash", f"""
    select distinct hash from tx_raw where {_REASON} is null""")
def _(v):
    stream = good_records(job.parsed(read_lines(v.spark, messages(v), 2), _arrived()))
    return _drain(job.unique(stream, _LONG), "unique").select("hash")


def _counts(v, label: str):
    schema = v.events.schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    logs = v.spark.sql(VIEW_SQL["audit_logs"].replace("from events", "from {events}"), events=stream)
    return _drain(job.windowed_counts(logs, label, length="1 hour"), "counts")


@query("T5_windowed_counts_by_severity", """
    select time_bucket(interval '1 hour', timestamp) as window_start,
           time_bucket(interval '1 hour', timestamp) + interval 1 hour as window_end, severity, count(*) as n
    from audit_logs group by 1, 2, 3
    having time_bucket(interval '1 hour', timestamp) + interval 1 hour
           <= (select max(timestamp) from audit_logs) - interval 10 minutes""")
def _(v):
    return _counts(v, "severity")


@query("T5_windowed_counts", """
    select time_bucket(interval '1 hour', timestamp) as window_start,
           time_bucket(interval '1 hour', timestamp) + interval 1 hour as window_end, status, count(*) as n
    from audit_logs group by 1, 2, 3
    having time_bucket(interval '1 hour', timestamp) + interval 1 hour
           <= (select max(timestamp) from audit_logs) - interval 10 minutes""")
def _(v):
    return _counts(v, "status")


def _score(v):
    """Run the job with a model fitted on all good records, so that the result does not
    depend on which file comes first."""
    folder = messages(v, 4)
    good = good_records(job.parsed(v.spark.read.text(folder), _arrived()))
    model = forest.fit(good, job.STREAM_FEATURES)
    paths = job.Paths(new_path(v.spark, "job"))
    scorer = job.BatchScorer(paths, model=model)
    running = job.start(read_lines(v.spark, folder, 1), scorer, _LONG, arrived=_arrived())
    running.awaitTermination()
    return paths, running


def _large_values(df):
    """A scoring function whose result SQL can state."""
    return df.withColumns({
        "anomaly_score": -F.col("value"), "confidence": F.col("value"),
        "anomaly": F.when(F.col("value") > 30_000, "anomaly").otherwise("normal")})


@query("T3_drained_remainder", f"""
    select count(distinct hash) as rows, cast(2 as bigint) as batches, cast(0 as bigint) as waiting
    from tx_raw where {_REASON} is null""")
def _(v):
    """A remainder smaller than a batch is processed too: five files, four at a time."""
    paths = job.Paths(new_path(v.spark, "job"))
    scorer = job.BatchScorer(paths, score_fn=_large_values)
    job.start(read_lines(v.spark, messages(v, 5), 4), scorer, _LONG, arrived=_arrived()).awaitTermination()
    return commits.read(v.spark, paths.predictions).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("batches"),
        F.count_if(F.col("anomaly") == "unscored").cast("bigint").alias("waiting"))


@query("T7_restart", f"""
    select count(distinct hash) as rows, count(distinct hash) as hashes
    from tx_raw where {_REASON} is null""")
def _(v):
    """Two runs from one checkpoint; the second finds files that came in between."""
    folder, paths = new_path(v.spark, "messages"), job.Paths(new_path(v.spark, "job"))
    early = F.xxhash64("value") > 0
    for part in (early, ~early):
        _lines(v).where(part).repartition(2).write.mode("append").text(folder)
        scorer = job.BatchScorer(paths, score_fn=_large_values)
        running = job.start(read_lines(v.spark, folder, 1), scorer, _LONG, arrived=_arrived())
        running.awaitTermination()
    return commits.read(v.spark, paths.predictions).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("hashes"))


@query("A8_sinks", f"""
    with r as (select hash, {_REASON} as reason, try_cast(value as double) as value from tx_raw)
    select 'predictions' as sink, count(distinct hash) as rows from r where reason is null
    union all select 'anomalies', count(distinct hash) from r where reason is null and value > 30000
    union all select 'rejects', count(*) from r where reason is not null""")
def _(v):
    paths = job.Paths(new_path(v.spark, "job"))
    scorer = job.BatchScorer(paths, score_fn=_large_values)
    running = job.start(read_lines(v.spark, messages(v, 4), 2), scorer, _LONG, arrived=_arrived())
    running.awaitTermination()
    sinks = None
    for name in ("predictions", "anomalies", "rejects"):
        rows = commits.read(v.spark, getattr(paths, name)).agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.withColumn("sink", F.lit(name))
        sinks = rows if sinks is None else sinks.unionByName(rows)
    return sinks


@query("T2_score_batches")
def _(v):
    paths, _running = _score(v)
    return commits.read(v.spark, paths.predictions).select(
        "hash", "anomaly", "anomaly_score", "value", "gas", "gasPrice")


@query("T2_scored_once", f"""
    select count(distinct hash) as rows, count(distinct hash) as hashes, cast(0 as bigint) as unscored
    from tx_raw where {_REASON} is null""")
def _(v):
    paths, _running = _score(v)
    return commits.read(v.spark, paths.predictions).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("hashes"),
        F.count_if(F.col("anomaly") == "unscored").cast("bigint").alias("unscored"))


@query("T4_anomaly_records")
def _(v):
    paths, _running = _score(v)
    return commits.read(v.spark, paths.anomalies).drop("batch_id", "detected_at")


def _rule_job(v):
    """The job with a scoring rule that SQL can state."""
    paths = job.Paths(new_path(v.spark, "job"))
    scorer = job.BatchScorer(paths, score_fn=_large_values)
    job.start(read_lines(v.spark, messages(v, 4), 2), scorer, _LONG, arrived=_arrived()).awaitTermination()
    return paths


_GOOD = f"""
    good as (select distinct hash, try_cast(value as double) as value, try_cast(gas_price as double) as price,
                    coalesce(make_timestamp(try_cast(time_stamp as bigint) * 1000000), timestamp '2024-02-01') as timestamp
             from tx_raw where {_REASON} is null)"""
_SEVERITY = """case when value > 1000000 or price > 100000 then 'critical' when value > 100000 or price > 50000 then 'high'
                    when value > 10000 or price > 10000 then 'medium' else 'low' end"""


@query("T4_anomalies_of_a_rule", f"""
    with {_GOOD} select hash, value, timestamp, {_SEVERITY} as severity, -value as anomaly_score, value as confidence
    from good where value > 30000""")
def _(v):
    stored = commits.read(v.spark, _rule_job(v).anomalies)
    return stored.select("hash", "value", "timestamp", "severity", "anomaly_score", "confidence")


@query("T6_live_view_of_a_rule", f"""
    with {_GOOD} select hash, {_SEVERITY} as severity, timestamp from good
    where value > 30000 and timestamp <= timestamp '2024-02-01' and timestamp >= timestamp '2024-02-01' - interval 20 days
    order by timestamp desc, hash limit 50""")
def _(v):
    from datetime import datetime

    from ledgerwatch.operators.buffer import live_entries

    stored = commits.read(v.spark, _rule_job(v).anomalies)
    return live_entries(
        stored, datetime(2024, 2, 1), 50, 20 * 86_400, key="hash", inserted_at="timestamp"
    ).select("hash", "severity", "timestamp")


@query("O4_stream_moments", f"""
    with {_GOOD}, x as (select 'value' as feature, try_cast(value as double) as x from tx_raw where {_REASON} is null
              union all select 'gasPrice', try_cast(gas_price as double) from tx_raw where {_REASON} is null)
    select feature, count(x) as n, round(avg(x), 4) as mean, round(var_samp(x) / 1e6, 4) as variance, min(x) as lo, max(x) as hi
    from x group by feature""")
def _(v):
    """One state row per micro-batch and feature, merged, against one pass over all rows."""
    paths = job.Paths(new_path(v.spark, "job"))
    stream = job.parsed(read_lines(v.spark, messages(v, 6), 2), _arrived())
    job.append_batches(stream, job.MomentKeeper(paths, ["value", "gasPrice"]), paths.checkpoint).awaitTermination()
    state = job.merged_moments(v.spark, paths)
    return state.select(
        "feature", "n", F.round("mean", 4).alias("mean"), F.round(F.col("m2") / (F.col("n") - 1) / 1e6, 4).alias("variance"), "lo", "hi")


@query("T8_job_status", f"""
    with {_GOOD}, r as (select count(*) as n from tx_raw where {_REASON} is not null),
         g as (select count(*) as n, count(*) filter (where value > 30000) as a from good)
    select 'processed_success' as metric_name, cast(n as double) as metric_value from g
    union all select 'processed_error', n from r union all select 'anomalies_detected', a from g
    union all select 'input_rows', g.n + r.n from g, r union all select 'batches', 2
    union all select 'consumer_lag', 57 union all select 'buffer_size', least(a, 1000) from g
    union all select 'buffer_utilization', least(a, 1000) / 1000 from g""")
def _(v):
    """Totals from the stored metrics, lag from a progress report, the size of the live view."""
    from datetime import datetime

    from ledgerwatch.operators.buffer import live_entries

    paths = _rule_job(v)
    progress = {"sources": [{"endOffset": {"tx": {"0": 100}}, "latestOffset": {"tx": {"0": 150, "1": 7}}}]}
    live = live_entries(commits.read(v.spark, paths.anomalies), datetime(2030, 1, 1), 1000, 10_000 * 86_400, key="hash")
    status = job.status_table(v.spark, paths, progress, live, 1000)
    return status.where("metric_name <> 'slowest_batch_millis'")


@query("T6_live_state", f"""
    with {_GOOD}, live as (
      select hash, {_SEVERITY} as severity, timestamp from good
      where value > 30000 and timestamp >= (select max(timestamp) from good where value > 30000) - interval 20 days)
    select severity, hash, timestamp from (
      select *, row_number() over (partition by severity order by timestamp desc, hash) as place from live) where place <= 25""")
def _(v):
    """The view that the state of the stream holds at its end, of four batches."""
    spark, checkpoint = v.spark, new_path(v.spark, "offsets")
    stream = good_records(job.parsed(read_lines(spark, messages(v, 4), 1), _arrived())).where("value > 30000")
    entries = stream.select("hash", job.transaction_severity(F.col("value"), F.col("gasPrice")).alias("severity"), "timestamp", "value")
    live.keep_live(entries, new_path(spark, "changes"), checkpoint, 25, 20 * 86_400, "hash", "timestamp").awaitTermination()
    return live.live_view(spark, checkpoint).select("severity", F.col("key").alias("hash"), F.col("inserted_at").alias("timestamp"))


@query("T3_short_stream", f"""
    select count(distinct hash) as rows, cast(0 as bigint) as waiting, 4 as batches
    from tx_raw where {_REASON} is null""")
def _(v):
    """Too few rows for a model on the way: those that wait are scored when the run ends."""
    paths = job.Paths(new_path(v.spark, "job"))
    scorer = job.BatchScorer(paths, min_training_rows=1 << 62)
    job.drain(read_lines(v.spark, messages(v, 4), 1), scorer, _LONG, arrived=_arrived())
    return commits.read(v.spark, paths.predictions).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("anomaly") == "unscored").cast("bigint").alias("waiting"),
        F.count_distinct("batch_id").cast("int").alias("batches"))


@query("T8_progress_reports", f"""
    with {_GOOD}, g as (select count(*) as n from good), b as (select count(*) as n from tx_raw where {_REASON} is not null)
    select cast(3 as bigint) as batches, (select count(*) from tx_raw) as input_rows, g.n as good, b.n as bad,
           cast(0 as bigint) as lag, true as timed from g, b""")
def _(v):
    """What the listener stored of a run, batch by batch."""
    paths = job.Paths(new_path(v.spark, "job"))
    job.drain(read_lines(v.spark, messages(v, 6), 2), job.BatchScorer(paths, score_fn=_large_values), _LONG, arrived=_arrived())
    reports = job.progress_table(v.spark, paths).where("input_rows > 0")
    return reports.agg(
        F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in ("input_rows", "good", "bad", "lag")],
        F.bool_and(F.col("millis") > 0).alias("timed"))


@query("A8_compacted_sink", f"""
    with r as (select hash, {_REASON} as reason from tx_raw)
    select count(*) as rows, count(distinct hash) as hashes, cast(2 as bigint) as batches from r where reason is null""")
def _(v):
    """Good rows of four batches in a table with a log; the first three gathered."""
    spark, path = v.spark, new_path(v.spark, "sink")
    good = good_records(job.parsed(read_lines(spark, messages(v, 4), 1), _arrived()))
    job.append_batches(good, lambda df, k: commits.write_batch(df, path, k), new_path(spark, "offsets")).awaitTermination()
    commits.compact(spark, path, 2)
    return commits.read(spark, path).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("hashes"), F.count_distinct("batch_id").alias("batches"))


@query("T6_live_view")
def _(v):
    from datetime import datetime

    from ledgerwatch.operators.buffer import live_entries

    paths, _running = _score(v)
    stored = commits.read(v.spark, paths.anomalies)
    return live_entries(
        stored, datetime(2024, 2, 1), 10_000, 40 * 86_400, key="hash", inserted_at="timestamp"
    ).select("hash", "severity", "timestamp", "anomaly_score")
