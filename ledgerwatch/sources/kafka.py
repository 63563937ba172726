"""Message sources: a Kafka topic, or text files with one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OFFSETS = ("earliest", "latest")


def kafka_options(
    servers: str, topic: str, group: str = "ledgerwatch", start: str = "latest",
    max_per_trigger: int | None = None, fail_on_data_loss: bool = True, **extra: str,
) -> dict[str, str]:
    """Reader options. ``start`` is earliest, latest or a JSON object of offsets; it only
    matters without a checkpoint, which otherwise knows where to go on."""
    if not servers or not topic:
        raise ValueError("servers and topic are required")
    if start not in _OFFSETS and not start.lstrip().startswith("{"):
        raise ValueError("start must be earliest, latest or a JSON object of offsets")
    if max_per_trigger is not None and max_per_trigger < 1:
        raise ValueError("max_per_trigger must be positive")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "groupIdPrefix": group,
        "startingOffsets": start,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options | {f"kafka.{k}": str(v) for k, v in extra.items()}


def read_kafka(spark: SparkSession, **settings) -> DataFrame:
    """The topic as a stream of (value, arrived)."""
    stream = spark.readStream.format("kafka").options(**kafka_options(**settings)).load()
    return stream.selectExpr("cast(value as string) as value", "timestamp as arrived")


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files as a stream of (value)."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)
