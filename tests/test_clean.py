import math
from datetime import datetime

import pytest
from conftest import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwatch.operators import clean as op
from ledgerwatch.sources import tables
from ledgerwatch.streaming.parse import good_records, rejected_records, validate

BASIC = [
    (100.0, 21000.0, 50.0), (200.0, 21000.0, 50.0), (None, 21000.0, 50.0), (0.0, None, 50.0),
    (500.0, 21000.0, 50.0), (600.0, 21000.0, 50.0), (700.0, 21000.0, None),
]
SCHEMA = "value double, gas double, gasPrice double"


def test_clean_keeps_order_of_steps(frame):
    df = frame(BASIC, SCHEMA)
    assert op.drop_duplicate_rows(df).count() == 7
    rows = {r.value: r for r in op.clean(df).collect()}
    assert sorted(rows) == [100, 200, 500, 600, 700]
    assert rows[700.0].gasPrice == 0


def test_duplicates(frame):
    rows = [(100, 21000, "a"), (200, 22000, "b"), (100, 21000, "a"), (300, 23000, "c"), (100, 21000, "a")]
    df = frame(rows, "value long, gas long, hash string")
    assert op.drop_duplicate_rows(df).count() == 3


def test_all_issues_and_counts(frame):
    rows = [(100.0, 21000.0), (200.0, 21000.0), (None, None), (0.0, 21000.0), (-50.0, 21000.0),
            (100.0, 21000.0), (300.0, 21000.0), (100.0, 21000.0)]
    df, counts = op.clean_with_counts(frame(rows, "value double, gas double"))
    assert sorted(column(df, "value")) == [100, 200, 300]
    assert counts.result == {"read": 8, "unique": 6, "valid": 3, "duplicates": 2, "invalid": 3}


def test_coercion_and_infinity(frame):
    df = op.keep_valid(frame([("100",), ("200",), ("invalid",), ("300",)], "value string"))
    assert column(df, "value", "value") == [100.0, 200.0, 300.0]
    special = [(100.0,), (math.inf,), (200.0,), (-math.inf,), (300.0,), (math.nan,)]
    assert sorted(column(op.clean(frame(special, "value double")), "value")) == [100, 200, 300, math.inf]


def test_fill_strings_only_on_request_and_never_times(frame):
    df = frame([(None, None, None)], "a double, s string, t timestamp")
    plain = op.fill_missing(df).first()
    assert (plain.a, plain.s, plain.t) == (0.0, None, None)
    filled = op.fill_missing(df, 0, fill_strings=True).first()
    assert (filled.s, filled.t) == ("0", None)


def test_missing_column_named(frame):
    with pytest.raises(ValueError, match="value"):
        op.keep_valid(frame([(1,)], "gas int"))


def test_timestamps(frame):
    df = frame([("0",), ("1609459200",), ("2147483647",), ("invalid",)], "timeStamp string")
    found = column(op.convert_timestamp(df), "timeStamp", "timeStamp")
    assert found == [None, datetime(1970, 1, 1), datetime(2021, 1, 1), datetime(2038, 1, 19, 3, 14, 7)]
    assert op.failed_timestamps(df).first().failed == 1


@pytest.mark.parametrize("values, expected", [
    ([100.0, 200.0, 300.0, 400.0], [0, 1 / 3, 2 / 3, 1]),
    ([-100.0, 0.0, 100.0, 200.0], [0, 1 / 3, 2 / 3, 1]),
    ([100.0, 100.0, 100.0], [0, 0, 0]),
    ([100.0, math.nan, 200.0, 300.0], [0, None, 0.5, 1]),
])
def test_min_max(frame, values, expected):
    df = frame(list(enumerate(values)), "i int, value double")
    assert column(op.min_max_scale(df, ["value"]), "value", "i") == pytest.approx(expected)


def test_min_max_text_and_errors(frame):
    df = frame([(0, "100"), (1, "200"), (2, "text"), (3, "300")], "i int, value string")
    assert column(op.min_max_scale(df, ["value"]), "value", "i") == [0, 0.5, None, 1]
    with pytest.raises(ValueError):
        op.min_max_scale(df, [])
    with pytest.raises(ValueError):
        op.min_max_scale(df, ["absent"])
    with pytest.raises(Exception, match="no numeric data"):
        op.min_max_scale(frame([("x",)], "value string"), ["value"]).collect()


def test_min_max_reads_the_bounds_once(frame):
    df = frame([(float(i), float(i * 2)) for i in range(10)], "a double, b double")
    plan = op.min_max_scale(df, ["a", "b"])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")]
    assert "ReusedSubquery" in final and "CartesianProduct" not in final


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=2, max_size=30))
def test_scaling_and_dedupe_properties(frame, values):
    df = frame([(v,) for v in values], "value double")
    scaled = column(op.min_max_scale(df, ["value"]), "value")
    assert all(0 <= x <= 1 for x in scaled)
    once = op.drop_duplicate_rows(df)
    assert once.count() == op.drop_duplicate_rows(once).count() == len({v + 0.0 for v in values})


def test_validate_records(frame):
    schema = "hash string, value string, gas string, gasPrice string, from string, blockNumber string"
    rows = [("0x123", "100", "21000", "20", "0xabc", "12345"), ("0x1", "100", None, None, None, None),
            ("0x2", "invalid", "1", "1", None, None)]
    checked = validate(frame(rows, schema), F.lit("2024-01-01").cast("timestamp"))
    good = good_records(checked).first()
    assert (good.value, good.gas, good.gasPrice, good["from"], good.to, good.blockNumber) == (
        100.0, 21000.0, 20.0, "0xabc", "", 12345)
    assert good.timestamp == datetime(2024, 1, 1)
    assert sorted(column(rejected_records(checked), "reason")) == ["invalid value", "missing gas"]
    only_two = validate(frame([("a", "1")], "hash string, value string"))
    assert only_two.first().reason == "missing gas"


def test_append_and_read_period(spark, frame, tmp_path):
    rows = [(f"h{i}", datetime(2024, 1, 1 + i % 3, i % 24), float(i)) for i in range(30)]
    tx = frame(rows, "hash string, timestamp timestamp, value double")
    path = str(tmp_path / "tx")
    tables.append_transactions(tx, path)
    tables.append_transactions(tx.withColumn("hash", F.concat("hash", F.lit("x"))), path)
    assert tables.read_transactions(spark, path).count() == 60
    day = tables.read_transactions(spark, path, datetime(2024, 1, 2), datetime(2024, 1, 2, 23))
    assert day.count() == 20
    new = tables.absent_rows(tx.unionByName(tx), tx.where("value < 25"))
    assert sorted(column(new, "hash")) == ["h25", "h26", "h27", "h28", "h29"]


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet", "orc"])
def test_read_raw_formats(spark, frame, tmp_path, fmt):
    raw = frame([("h", "a", "b", "1", "2", "3", "1609459200", "7")], tables.RAW_TRANSACTION)
    path = str(tmp_path / fmt)
    writer = raw.write.option("header", "true") if fmt == "csv" else raw.write
    writer.format(fmt).save(path)
    row = tables.typed_transactions(tables.read_raw(spark, path, fmt)).first()
    assert (row.value, row.gas, row.timestamp) == (1.0, 2.0, datetime(2021, 1, 1))
