"""Bucketed tables and lookups that skip row groups."""

import hashlib
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwatch import session
from ledgerwatch.operators import joins, lookup
from ledgerwatch.sources import tables

SCHEMA = "hash string, from_address string, to_address string, value double, gas double, gas_price double, block_number long, timestamp timestamp"


def rows(n, start=0):
    def text(k):
        return "0x" + hashlib.md5(str(k).encode()).hexdigest()

    at = datetime(2024, 1, 1)
    return [(text(i), text(f"a{i % 500}"), text(f"b{i % 311}"), float(i), 1.0, 2.0, i, at + timedelta(minutes=i)) for i in range(start, start + n)]


def leaves(df):
    plan = df._jdf.queryExecution().executedPlan()
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_side_is_never_shuffled(spark, tmp_path, no_broadcast):
    tx = spark.createDataFrame(rows(800), SCHEMA)
    stored = tables.save_bucketed(tx, "tx_plain", str(tmp_path / "tx"), 5)
    anomalies = spark.createDataFrame([(r[0], "high") for r in rows(50, 780)], "tx_hash string, severity string")
    with tables.partitions_of(spark, "tx_plain"):
        joined = joins.with_transaction(anomalies, stored)
        assert exchanges(joined) == 1 and exchanges(joins.with_transaction(anomalies, tx)) == 2
        assert {(r.tx_hash, r.value) for r in joined.collect()} == {(r[0], r[3] if r[3] < 800 else None) for r in rows(50, 780)}
        assert exchanges(tables.absent_rows(tx, stored)) == 1
        members = lookup.members_of(stored, anomalies.withColumnRenamed("tx_hash", "hash"))
        assert exchanges(members) == 1 and members.count() == 20
    spark.sql("drop table tx_plain")


def test_insert_absent(spark, tmp_path):
    path, schema = str(tmp_path / "tx"), spark.createDataFrame([], SCHEMA).schema
    tables.save_bucketed(spark.createDataFrame(rows(100), SCHEMA), "tx_grow", path, 4)
    batch = spark.createDataFrame(rows(80, 60) + rows(80, 60), SCHEMA).withColumn("extra", F.lit(1))
    assert tables.insert_absent(batch, "tx_grow") == 40
    assert tables.insert_absent(batch, "tx_grow") == 0
    assert tables.insert_absent(batch.limit(0), "tx_grow") == 0
    assert sorted(r.value for r in spark.table("tx_grow").collect()) == [float(i) for i in range(140)]
    spark.sql("drop table tx_grow")  # as in a new session: the files stay
    again = tables.open_bucketed(spark, "tx_grow", path, schema, 4)
    assert again.count() == 140 and tables.buckets_of(spark, "tx_grow") == 4
    assert tables.insert_absent(spark.createDataFrame(rows(10, 135), SCHEMA), "tx_grow") == 5
    spark.sql("drop table tx_grow")
    spark.range(3).write.saveAsTable("plain_ids", path=str(tmp_path / "ids"))
    with pytest.raises(ValueError):
        tables.buckets_of(spark, "plain_ids")
    spark.sql("drop table plain_ids")


def test_lookups_skip_row_groups(spark, tmp_path):
    """A lookup by hash or address scans a small share of the rows, and finds the same ones."""
    tx, path = spark.createDataFrame(rows(40_000), SCHEMA), str(tmp_path / "lookup")
    tables.write_lookup(tx, path, "month", distinct=5_000, group_bytes=64 << 10, files=4)
    stored = tables.read_transactions(spark, path)
    some = rows(1, 12_345)[0]
    for found, plain in ((lookup.by_hash(stored, some[0]), lookup.by_hash(tx, some[0])),
                         (stored.where(F.col("from_address") == some[1]), tx.where(F.col("from_address") == some[1])),
                         (stored.where(F.col("hash") == "0xnone"), tx.where(F.col("hash") == "0xnone"))):
        assert {r.hash for r in found.collect()} == {r.hash for r in plain.collect()}
        scanned = sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves(found))
        assert scanned <= 0.2 * 40_000, scanned
    page = lookup.by_address(stored, some[1], None, 3, 20).select("hash").collect()
    assert page == lookup.by_address(tx, some[1], None, 3, 20).select("hash").collect()


def test_inserts_in_rounds_equal_one(spark, tmp_path):
    """Also for repeated hashes, whose earliest row counts, and for rows without hash or time."""
    early, late = rows(150, 60), [(*r[:7], r[7] + timedelta(days=1)) for r in rows(150, 60)]
    odd = [(None, *r[1:]) for r in rows(3, 400)] + [(*r[:7], None) for r in rows(20, 100)]
    found = []
    for rounds in (1, 4):
        name, path = f"tx_rounds_{rounds}", str(tmp_path / str(rounds))
        tables.save_bucketed(spark.createDataFrame(rows(100), SCHEMA), name, path, 6)
        inserted = tables.insert_absent(spark.createDataFrame(late + early + odd + early, SCHEMA), name, rounds=rounds)
        found.append((inserted, sorted(map(str, spark.table(name).collect()))))
        assert inserted == 111 and spark.table(name).where("timestamp is null").count() == 20
        assert spark.table(name).where("timestamp > '2024-01-02'").count() == 0
        spark.sql(f"drop table {name}")
    assert found[0] == found[1]
    with pytest.raises(ValueError):
        tables.insert_absent(spark.createDataFrame(early, SCHEMA), "any", rounds=0)
    assert [tables.rounds_for(n) for n in (1, tables.ROUND_BUCKETS, tables.ROUND_BUCKETS + 1, 10 * tables.ROUND_BUCKETS)] == [1, 1, 2, 10]


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_inserts_leave_no_copies(spark, tmp_path, monkeypatch):
    """Neither files of their shuffles nor a second copy of the rows, and these are shuffled once."""
    tables.save_bucketed(spark.createDataFrame(rows(100), SCHEMA), "tx_lean", str(tmp_path / "tx"), 4)
    before, shared = shuffle_files(spark), os.listdir(session.shared_dir(spark))
    seen, absent = [], tables.absent_rows
    monkeypatch.setattr(tables, "absent_rows", lambda new, *rest: seen.append(absent(new, *rest)) or seen[0])
    assert tables.insert_absent(spark.createDataFrame(rows(200, 60), SCHEMA), "tx_lean") == 160
    with tables.partitions_of(spark, "tx_lean"):
        assert exchanges(seen[0].repartition(4, "hash")) == 1
    left = None
    for _ in range(50):  # they are removed in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and os.listdir(session.shared_dir(spark)) == shared
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"
    spark.sql("drop table tx_lean")
