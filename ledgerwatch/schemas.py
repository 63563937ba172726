"""Declared table schemas. Amounts stay ``double``: the source system stores floats."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _L, _I, _B, _T = (
    StringType(), DoubleType(), LongType(), IntegerType(), BooleanType(), TimestampType(),
)

RAW_TRANSACTION = _table(
    hash=_S, from_address=_S, to_address=_S, value=_S, gas=_S, gas_price=_S,
    time_stamp=_S, block_number=_S,
)

# JSON keys of one stream message; every value arrives as text so that a bad number is
# rejected by the parser instead of nulling the whole record.
STREAM_MESSAGE = StructType([
    StructField(name, _S, True)
    for name in ("hash", "value", "gas", "gasPrice", "from", "to", "timestamp", "blockNumber")
])

TRANSACTION = _table(
    id=_L, hash=_S, block_number=_L, timestamp=_T, from_address=_S, to_address=_S, value=_D,
    gas=_D, gas_price=_D, gas_used=_D, nonce=_I, input_data=_S, created_at=_T,
)

ANOMALY = _table(
    id=_L, transaction_id=_L, model_id=_I, anomaly_score=_D, severity=_S, confidence=_D,
    features_used=MapType(_S, _D), explanation=_S, detected_at=_T, reviewed=_B,
    reviewed_by=_S, reviewed_at=_T, false_positive=_B,
)

MODEL = _table(
    id=_I, name=_S, model_type=_S, description=_S, is_active=_B, created_by=_S, created_at=_T,
)

MODEL_VERSION = _table(
    id=_I, model_id=_I, version=_S, storage_path=_S, checksum=_S, training_dataset_size=_L,
    training_duration_seconds=_D, hyperparameters=MapType(_S, _D), metrics=MapType(_S, _D),
    is_deployed=_B, deployed_at=_T, traffic_percentage=_D, created_at=_T, created_by=_S,
)

PREDICTION = _table(
    id=_L, transaction_id=_L, model_version_id=_I, user_id=_S, is_anomaly=_B, confidence=_D,
    anomaly_score=_D, request_id=_S, response_time_ms=_D, created_at=_T,
)

AUDIT_LOG = _table(
    id=_L, event_type=_S, user_id=_S, resource=_S, action=_S, status=_S, ip_address=_S,
    user_agent=_S, details=MapType(_S, _S), severity=_S, timestamp=_T,
)

SYSTEM_METRIC = _table(
    id=_L, metric_name=_S, metric_value=_D, tags=MapType(_S, _S), timestamp=_T,
)

USER = _table(id=_L, email=_S, is_active=_B, roles=ArrayType(_S), created_at=_T)
