"""The streaming job: parse, check, remove repeats, score each micro-batch, store.

Offsets and duplicate state live in the checkpoint. A micro-batch may be run again after a
failure, so every sink is a table with a commit log that replaces a batch as a whole: a repeat
leaves the same rows, once, wherever a run was ended. ``compact`` gathers old batches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerwatch.functions.classify import transaction_severity
from ledgerwatch.operators import forest
from ledgerwatch.operators.extras import batch_moments, merge_moments
from ledgerwatch.operators.stats import BUFFER_SIZE, consumer_lag
from ledgerwatch.session import state_partitions
from ledgerwatch.sources import commits
from ledgerwatch.sources.commits import compact, path_exists, write_batch
from ledgerwatch.streaming.parse import from_json_text, good_records, rejected_records, validate

STREAM_FEATURES = ("value", "gas", "gasPrice")
MIN_TRAINING_ROWS = 256


@dataclass(frozen=True)
class Paths:
    """Folders of one job."""

    root: str

    @property
    def model(self) -> str:
        return f"{self.root}/model"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def anomalies(self) -> str:
        return f"{self.root}/anomalies"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"

    @property
    def waiting(self) -> str:
        """Good rows of batches that came before there was a model."""
        return f"{self.root}/waiting"

    @property
    def flags(self) -> str:
        """Number of anomalies of every scored batch."""
        return f"{self.root}/flags"

    @property
    def progress(self) -> str:
        """Progress reports by batch."""
        return f"{self.root}/progress"

    @property
    def moments(self) -> str:
        return f"{self.root}/moments"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def parsed(messages: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Typed records with their arrival time and reject reason, from a batch or a stream of
    JSON text. The arrival is that of the source where it has one."""
    if arrived is None:
        arrived = F.col("arrived") if "arrived" in messages.columns else F.current_timestamp()
    timed = messages.withColumn("arrived", arrived.cast("timestamp"))
    return validate(from_json_text(timed), F.col("arrived"))


def unique(records: DataFrame, delay: str = "1 day", key: str = "hash", ts: str = "arrived") -> DataFrame:
    """One record per key among those that arrive within the delay of each other.

    The watermark runs on the arrival, not on the time inside the record: arrivals only move
    forward, so an old record, or one with a wrong clock, is never dropped as late. A repeat
    that arrives more than the delay after the first passes: state must end somewhere, so
    choose a delay beyond which no sender tries again.
    """
    if not records.isStreaming:
        return records.dropDuplicates([key])
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def anomaly_records(detected: DataFrame) -> DataFrame:
    """The stored form of what the model flags."""
    return forest.only_anomalies(detected).select(
        "hash", "value", "gas", "gasPrice", "from", "to", "timestamp",
        F.current_timestamp().alias("detected_at"),
        transaction_severity(F.col("value"), F.col("gasPrice")).alias("severity"),
        "anomaly_score", "confidence",
    )


_SCORED = ("hash", "is_anomaly", "confidence", "anomaly_score", "anomaly", "created_at", "value", "gas", "gasPrice",
           "from", "to", "timestamp")


class BatchScorer:
    """Scores micro-batches with a given model, or with one fitted on the first rows.

    Until ``min_training_rows`` good rows have come, they wait: they are stored, visible as
    ``unscored``. The batch that completes them fits the model on all of them and scores the
    waiting batches along with its own, in their own places; ``finish`` does so when a run ends
    before. Every step replaces a batch as a whole, its number of anomalies included, and the
    waiting rows go last, so a batch that runs again repeats it all with the same outcome.
    """

    def __init__(
        self, paths: Paths, contamination: float = 0.01, seed: int = 42,
        min_training_rows: int = MIN_TRAINING_ROWS, model: forest.Forest | None = None,
        score_fn: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        forest.check_parameters(contamination, seed)
        self.paths, self.contamination, self.seed = paths, contamination, seed
        self.min_training_rows, self.model, self.score_fn = min_training_rows, model, score_fn

    def _waiting(self, spark: SparkSession, before: int) -> DataFrame | None:
        """Rows of earlier batches that have no score yet."""
        if self.score_fn is not None or not commits.log(spark, self.paths.waiting):
            return None
        return commits.read(spark, self.paths.waiting).where(F.col("batch_id") < before)

    def _ready(self, good: DataFrame, rows: int, waiting: DataFrame | None) -> bool:
        if self.score_fn is not None or self.model is not None:
            return True
        spark = good.sparkSession
        if path_exists(spark, f"{self.paths.model}/meta"):
            self.model = forest.load(spark, self.paths.model)
        else:
            every = good if waiting is None else good.unionByName(waiting.drop("batch_id"))
            if rows + (waiting.count() if waiting is not None else 0) >= self.min_training_rows:
                self.model = forest.fit(every, STREAM_FEATURES, self.contamination, self.seed)
                forest.save(spark, self.model, self.paths.model)
        return self.model is not None

    def _store(self, good: DataFrame, batch_id: int) -> None:
        """Score and store rows, and the number of anomalies, under the number of their batch."""
        spark = good.sparkSession
        detected = self.score_fn(good) if self.score_fn is not None else forest.detect(good, self.model)
        stored = detected.withColumns({
            "is_anomaly": F.col("anomaly") == "anomaly", "created_at": F.current_timestamp()})
        write_batch(stored.select(*_SCORED), self.paths.predictions, batch_id)
        kept = commits.read(spark, self.paths.predictions).where(F.col("batch_id") == batch_id)
        write_batch(anomaly_records(kept), self.paths.anomalies, batch_id)
        counted = kept.agg(F.count_if("is_anomaly").cast("double").alias("metric_value"))
        write_batch(counted.select(F.lit("anomalies_detected").alias("metric_name"), "metric_value"), self.paths.flags, batch_id)

    def _store_waiting(self, spark: SparkSession, waiting: DataFrame) -> None:
        for row in waiting.select("batch_id").distinct().collect():
            self._store(waiting.where(F.col("batch_id") == row["batch_id"]).drop("batch_id"), row["batch_id"])
        commits.drop(spark, self.paths.waiting)

    def finish(self, spark: SparkSession) -> int:
        """Score the rows that still wait when a bounded run has ended; their number.

        Without a model one is fitted on all of them, however few they are. Safe to repeat.
        """
        if self.score_fn is not None or not commits.log(spark, self.paths.waiting):
            return 0
        waiting = commits.read(spark, self.paths.waiting)
        rows = waiting.count()
        if rows:
            if self.model is None and path_exists(spark, f"{self.paths.model}/meta"):
                self.model = forest.load(spark, self.paths.model)
            if self.model is None:
                self.model = forest.fit(waiting.drop("batch_id"), STREAM_FEATURES, self.contamination, self.seed)
                forest.save(spark, self.model, self.paths.model)
            self._store_waiting(spark, waiting)
        return rows

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        began, spark, kept = time.monotonic(), batch.sparkSession, batch.persist()
        try:
            good, bad = good_records(kept), rejected_records(kept)
            write_batch(bad, self.paths.rejects, batch_id)
            counts = kept.agg(
                F.count_if(F.col("reason").isNull()).alias("good"),
                F.count_if(F.col("reason").isNotNull()).alias("bad"),
            ).first()
            waiting = self._waiting(spark, batch_id)
            ready = self._ready(good, counts["good"], waiting)
            if ready and counts["good"]:
                self._store(good, batch_id)
            elif counts["good"]:
                write_batch(good, self.paths.waiting, batch_id)
                nothing = F.lit(None).cast("double")
                write_batch(good.withColumns({
                    "is_anomaly": F.lit(None).cast("boolean"), "confidence": nothing, "anomaly_score": nothing,
                    "anomaly": F.lit("unscored"), "created_at": F.current_timestamp(),
                }).select(*_SCORED), self.paths.predictions, batch_id)
            row = [
                ("processed_success", float(counts["good"])), ("processed_error", float(counts["bad"])),
                ("batches", 1.0), ("batch_millis", 1000 * (time.monotonic() - began)),
            ]
            write_batch(
                spark.createDataFrame(row, "metric_name string, metric_value double")
                .withColumn("timestamp", F.current_timestamp()).coalesce(1),
                self.paths.metrics, batch_id,
            )
            if ready and waiting is not None:
                self._store_waiting(spark, waiting)
        finally:
            kept.unpersist()


class MomentKeeper:
    """Keeps count, mean, squared deviations, min and max of every micro-batch as a state row
    per feature; ``merged_moments`` is the state of all batches so far."""

    def __init__(self, paths: Paths, columns: Sequence[str]) -> None:
        self.paths, self.columns = paths, tuple(columns)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        write_batch(batch_moments(good_records(batch), self.columns).coalesce(1), self.paths.moments, batch_id)


def merged_moments(spark: SparkSession, paths: Paths) -> DataFrame:
    """The stored states of all micro-batches, combined."""
    return merge_moments(commits.read(spark, paths.moments).drop("batch_id"))


class ProgressKeeper(StreamingQueryListener):
    """Stores each progress report of one query under its batch number; a repeat replaces it.

    The report is a small file, written by the driver as soon as the batch is done: input
    rows, durations, source offsets, and the good and bad rows that the stream observed.
    """

    def __init__(self, spark: SparkSession, paths: Paths, name: str) -> None:
        self.folder, self.name = commits._Folder(spark, paths.progress), name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = event.progress
        if report.name != self.name:
            return
        seen, arrived = (report.observedMetrics.get(n) for n in ("records", "arrived"))
        text = json.dumps({
            "batch_id": report.batchId, "reported_at": report.timestamp, "input_rows": report.numInputRows if arrived is None else arrived["rows"],
            "good": None if seen is None else seen["good"], "bad": None if seen is None else seen["bad"],
            "millis": report.durationMs.get("triggerExecution"), "lag": sum(
                max(0, end - at) for _, _, at, end in kafka_offsets(json.loads(report.json)))})
        part = f"{self.folder.root}/{report.batchId:020d}"
        self.folder.write(f"{part}.tmp", text + "\n")
        self.folder.remove(f"{part}.json")
        self.folder.system.rename(self.folder.at(f"{part}.tmp"), self.folder.at(f"{part}.json"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_table(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per reported micro-batch of all runs: ``batch_id, reported_at, input_rows, good,
    bad, millis, lag``. A batch without input reports nothing observed."""
    schema = "batch_id long, reported_at timestamp, input_rows long, good long, bad long, millis long, lag long"
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(paths.progress)


def start(
    messages: DataFrame, scorer: BatchScorer, delay: str = "1 day", available_now: bool = True,
    arrived: Column | None = None, every: str = "5 seconds", name: str | None = None,
) -> StreamingQuery:
    """Start the job. ``available_now`` drains what is there, in bounded batches, and ends.

    Rows that wait for a model stay waiting for the next run; ``drain`` scores them too.
    """
    # Good and bad rows take two ways, so the source is read twice and would be counted twice.
    arrivals = parsed(messages, arrived).observe("arrived", F.count(F.lit(1)).alias("rows"))
    records = unique_good(arrivals, delay).observe(
        "records", F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    writer = records.writeStream.foreachBatch(scorer).option(
        "checkpointLocation", scorer.paths.checkpoint
    )
    if name is not None:
        writer = writer.queryName(name)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    with state_partitions(messages.sparkSession):
        return writer.trigger(**trigger).start()


def drain(
    messages: DataFrame, scorer: BatchScorer, delay: str = "1 day", arrived: Column | None = None,
) -> StreamingQuery:
    """A whole bounded run: all present input, progress reports stored, and every good row scored,
    also when too few came for a model to be fitted on the way."""
    spark = messages.sparkSession
    name = f"job-{uuid.uuid4().hex}"
    keeper = ProgressKeeper(spark, scorer.paths, name)
    spark.streams.addListener(keeper)
    try:
        running = start(messages, scorer, delay, arrived=arrived, name=name)
        running.awaitTermination()
        wait_for_report(running, keeper)
    finally:
        spark.streams.removeListener(keeper)
    scorer.finish(spark)
    return running


def wait_for_report(running: StreamingQuery, keeper: ProgressKeeper, seconds: float = 10) -> None:
    """Reports come in a thread of their own: wait until that of the last batch is stored."""
    last, until = running.lastProgress, time.monotonic() + seconds
    while last is not None and time.monotonic() < until:
        if f"{last['batchId']:020d}.json" in keeper.folder.names(keeper.folder.root):
            return
        time.sleep(0.05)


def unique_good(records: DataFrame, delay: str) -> DataFrame:
    """Repeats removed among good records; every rejected one stays, however often it comes."""
    good = unique(records.where(F.col("reason").isNull()), delay)
    return good.unionByName(records.where(F.col("reason").isNotNull()))


# -- counts over event time --------------------------------------------------------------


def windowed_counts(
    rows: DataFrame, label: str, ts: str = "timestamp", length: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Rows per label and window; on a stream with a watermark, so windows close."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, length), label).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), label, "n"
    )


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table until the present input is used up."""
    writer = (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    with state_partitions(df.sparkSession):
        return writer.start()


def append_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch to a sink that stores it under its number, until the input is used up."""
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    with state_partitions(df.sparkSession):
        return writer.trigger(availableNow=True).start()


# -- status ------------------------------------------------------------------------------


def status_table(
    spark: SparkSession, paths: Paths, progress: dict | None = None, live: DataFrame | None = None,
    max_size: int = BUFFER_SIZE,
) -> DataFrame:
    """Totals of the whole run, from what each batch stored under its number, so that a batch
    that ran twice counts once: processed rows, errors, anomalies, batches, the slowest batch; from the last
    progress report of a Kafka source the lag over all partitions; from a live view its size and share of the bound.
    """
    stored = commits.read(spark, paths.metrics).select("metric_name", "metric_value")
    if path_exists(spark, paths.flags):
        stored = stored.unionByName(commits.read(spark, paths.flags).select("metric_name", "metric_value"))
    totals = stored.where("metric_name <> 'batch_millis'").groupBy("metric_name").agg(
        F.sum("metric_value").alias("metric_value")
    )
    rows = stored.where("metric_name like 'processed%'").agg(F.sum("metric_value").alias("metric_value"))
    slowest = stored.where("metric_name = 'batch_millis'").agg(F.max("metric_value").alias("metric_value"))
    table = totals.unionByName(rows.withColumn("metric_name", F.lit("input_rows"))).unionByName(
        slowest.withColumn("metric_name", F.lit("slowest_batch_millis")))
    if progress is not None:
        offsets = spark.createDataFrame(
            kafka_offsets(progress), "topic string, partition int, position long, end_offset long")
        lag = consumer_lag(offsets).where("partition >= 0").agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("double").alias("metric_value"))
        table = table.unionByName(lag.withColumn("metric_name", F.lit("consumer_lag")))
    if live is not None:
        size = live.agg(F.count(F.lit(1)).cast("double").alias("n"))
        table = table.unionByName(size.select(F.inline(F.array(
            F.struct(F.lit("buffer_size").alias("metric_name"), F.col("n").alias("metric_value")),
            F.struct(F.lit("buffer_utilization").alias("metric_name"), (F.col("n") / F.lit(max_size)).alias("metric_value")),
        ))))
    return table


def kafka_offsets(progress: dict) -> list[tuple]:
    """(topic, partition, position, end_offset) from one progress report of a Kafka source."""
    def parse(text) -> dict:
        return json.loads(text) if isinstance(text, str) else (text or {})

    rows = []
    for source in progress.get("sources", []):
        reached, latest = parse(source.get("endOffset")), parse(source.get("latestOffset"))
        for topic, parts in latest.items():
            for part, end in parts.items():
                rows.append((topic, int(part), int(reached.get(topic, {}).get(part, 0)), int(end)))
    return rows
