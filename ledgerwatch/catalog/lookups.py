"""Queries: lookups over stored tables, joins."""

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.functions.numeric import rounded
from ledgerwatch.operators import joins, lookup
from ledgerwatch.session import new_path
from ledgerwatch.sources import tables

AS_OF = datetime(1998, 1, 1)


def _address(key: int) -> str:
    return "0x" + hashlib.md5(str(key).encode()).hexdigest()


@query("Q1_by_hash", """
    select * from tx where hash = '0x' || md5('5979|1616|79|6')""")
def _(v):
    return lookup.by_hash(v.tx, "0x" + hashlib.md5(b"5979|1616|79|6").hexdigest())


@query("Q2_by_address", f"""
    select hash, timestamp, value from tx
    where from_address = '{_address(42)}' or to_address = '{_address(42)}'
    order by timestamp desc, hash limit 50 offset 10""")
def _(v):
    return lookup.by_address(v.tx, _address(42), None, skip=10, limit=50).select(
        "hash", "timestamp", "value")


@query("Q2_received_by", f"""
    select hash, timestamp, value from tx where to_address = '{_address(7)}'
    order by timestamp desc, hash limit 100""")
def _(v):
    return lookup.by_address(v.tx, _address(7), False).select("hash", "timestamp", "value")


@query("Q3_by_date_range", """
    select hash, timestamp, value from tx
    where timestamp between timestamp '1997-06-01' and timestamp '1997-12-31'
    order by timestamp, hash limit 200 offset 20""")
def _(v):
    return lookup.by_date_range(
        v.tx, datetime(1997, 6, 1), datetime(1997, 12, 31), skip=20, limit=200
    ).select("hash", "timestamp", "value")


@query("Q3_next_page", """
    select hash, timestamp, value from tx
    where timestamp between timestamp '1997-06-01' and timestamp '1997-12-31'
    order by timestamp, hash limit 50 offset 50""")
def _(v):
    """The page after the fiftieth row, found from that row's values."""
    period = v.tx.where(F.col("timestamp").between(F.lit(datetime(1997, 6, 1)), F.lit(datetime(1997, 12, 31))))
    order = [("timestamp", True), ("hash", True)]
    last = lookup.page_after(period, order, None, 50).select("timestamp", "hash").collect()[-1]
    return lookup.page_after(period, order, list(last), 50).select("hash", "timestamp", "value")


@query("Q4_high_value", """
    select hash, value from tx where value >= 90000 order by value desc, hash limit 100""")
def _(v):
    return lookup.high_value(v.tx, 90000.0).select("hash", "value")


@query("Q5_batch_lookup", f"""
    select hash, value from tx
    where hash in ('0x' || md5('5979|1616|79|6'), '0x' || md5('7124|756|22|7'), '0xmissing')""")
def _(v):
    hashes = ["0x" + hashlib.md5(t).hexdigest() for t in (b"5979|1616|79|6", b"7124|756|22|7")]
    return lookup.by_hashes(v.tx, [*hashes, "0xmissing"]).select("hash", "value")


@query("Q5_lookup_totals", """
    with wanted as (select distinct tx_hash as hash from anomalies
                    union select hash from tx_raw)
    select count(*) as requested, count(*) filter (where hash in (select hash from tx)) as found,
           count(*) filter (where hash not in (select hash from tx)) as missing
    from wanted""")
def _(v):
    wanted = v.anomalies.select(F.col("tx_hash").alias("hash")).union(v.tx_raw.select("hash"))
    return lookup.lookup_totals(v.tx, wanted)


@query("Q6_by_severity", """
    select * from anomalies where severity = 'high' order by detected_at desc, tx_hash
    limit 100 offset 25""")
def _(v):
    return lookup.anomalies_by_severity(v.anomalies, "high", skip=25)


_RANK = "case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 when 'critical' then 3 end"


@query("Q7_review_queue", f"""
    select tx_hash, severity, detected_at from anomalies where not reviewed
    order by {_RANK} desc, detected_at, tx_hash limit 150""")
def _(v):
    return lookup.review_queue(v.anomalies, limit=150).select("tx_hash", "severity", "detected_at")


@query("Q8_recent_anomalies", """
    select * from anomalies
    where detected_at between timestamp '1998-01-01' - interval 240 hours and timestamp '1998-01-01'
      and severity = 'medium'
    order by detected_at desc, tx_hash limit 100""")
def _(v):
    return lookup.recent_anomalies(v.anomalies, AS_OF, 240, "medium")


@query("Q9_anomaly_total", "select count(*) as total from anomalies")
def _(v):
    return lookup.count_rows(v.anomalies)


@query("Q10_by_model_version", """
    select * from anomalies where model_version_id = 2
      and detected_at between timestamp '1997-11-25' and timestamp '1998-01-01'""")
def _(v):
    return lookup.by_model_version(v.anomalies, 2, datetime(1997, 11, 25), AS_OF)


@query("Q11_deployed_versions", "select * from model_versions where is_deployed and model_id = 3")
def _(v):
    return lookup.deployed_versions(v.model_versions, 3)


@query("Q11_latest_versions", """
    select model_id, arg_max(id, created_seq) as id, arg_max(version, created_seq) as version,
           arg_max(is_deployed, created_seq) as is_deployed
    from model_versions group by model_id""")
def _(v):
    return lookup.latest_versions(v.model_versions)


@query("Q11_lineage", """
    select * from model_versions where model_id = 1 order by created_seq desc""")
def _(v):
    return lookup.model_lineage(v.model_versions, 1)


@query("Q12_models", """
    select cast(n_nationkey as int) as id, n_name as name from nation
    where n_regionkey = 1 and n_nationkey > 2""")
def _(v):
    models = v.nation.select(
        F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("type_"), F.col("n_regionkey")).alias("model_type"),
        (F.col("n_nationkey") > 2).alias("is_active"),
    )
    return lookup.models_where(models, model_type="type_1", active=True).select("id", "name")


@query("Q13_audit_rows", """
    select * from audit_logs where event_type = 'admin' and severity = 'warning'
      and timestamp between timestamp '2024-01-05' and timestamp '2024-01-20'
    order by timestamp desc, id desc limit 100""")
def _(v):
    return lookup.audit_rows(
        v.audit_logs, event_type="admin", severity="warning",
        start=datetime(2024, 1, 5), end=datetime(2024, 1, 20),
    )


@query("Q13_newest_of_user", """
    select * from audit_logs where user_id = '42' order by timestamp desc, id desc limit 20""")
def _(v):
    return lookup.audit_rows(v.audit_logs, user_id="42", limit=20, order="asc")


@query("Q14_page", """
    select * from audit_logs order by timestamp desc, id desc limit 100 offset 300""")
def _(v):
    return lookup.list_rows(v.audit_logs, "timestamp", skip=300, limit=100)


@query("Q15_users_with_role", """
    select c_custkey as id, lower(c_name) || '@example.org' as email from customer
    where c_acctbal > 0 and c_mktsegment = 'BUILDING'""")
def _(v):
    users = v.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.array("c_mktsegment", F.lit("USER")).alias("roles"),
    )
    return lookup.users_where(users, active=True, role="BUILDING").select("id", "email")


@query("Q16_apply_reviews", """
    with decisions as (
        select tx_hash, 'first' as reviewer, true as is_fp, detected_at as decided_at from anomalies
        where severity <> 'critical'
        union all
        select tx_hash, 'second', false, detected_at + interval 1 day from anomalies
        where severity = 'high'),
    last as (select tx_hash, max(decided_at) as decided_at, arg_max(reviewer, decided_at) as reviewer,
                    arg_max(is_fp, decided_at) as is_fp from decisions group by tx_hash)
    select a.tx_hash, a.severity, (l.tx_hash is not null or a.reviewed) as reviewed,
           l.reviewer as reviewed_by, l.decided_at as reviewed_at,
           case when l.tx_hash is not null then l.is_fp else a.false_positive end as false_positive
    from anomalies a left join last l on a.tx_hash = l.tx_hash""")
def _(v):
    a = v.anomalies
    first = a.where("severity <> 'critical'").select(
        "tx_hash", F.lit("first").alias("reviewer"), F.lit(True).alias("is_false_positive"),
        F.col("detected_at").alias("decided_at"),
    )
    second = a.where("severity = 'high'").select(
        "tx_hash", F.lit("second"), F.lit(False), F.col("detected_at") + F.expr("interval 1 day"),
    )
    return lookup.apply_reviews(a, first.union(second), "tx_hash").select(
        "tx_hash", "severity", "reviewed", "reviewed_by", "reviewed_at", "false_positive"
    )


@query("J1_anomaly_with_transaction", """
    select a.tx_hash, a.severity, t.value, t.gas, t.from_address, t.timestamp
    from anomalies a left join tx t on a.tx_hash = t.hash""")
def _(v):
    return joins.with_transaction(v.anomalies, v.tx).select(
        "tx_hash", "severity", "value", "gas", "from_address", "timestamp")


@query("J2_label_by_anomaly", """
    with latest as (select tx_hash, max(struct_pack(d := detected_at, m := model_version_id,
                           s := severity, c := anomaly_score)) as a from anomalies group by tx_hash)
    select t.hash, t.value, l.a is not null as is_anomaly, l.a.s as severity,
           round(l.a.c, 6) as anomaly_score
    from tx t left join latest l on t.hash = l.tx_hash""")
def _(v):
    return joins.label_by_anomaly(v.tx, v.anomalies).select(
        "hash", "value", "is_anomaly", "severity",
        rounded(F.col("anomaly_score")).alias("anomaly_score"))


@query("J3_split_by_cache", """
    with live as (select distinct tx_hash from anomalies
                  where detected_at > timestamp '1998-01-01' - interval 31536000 seconds
                    and detected_at <= timestamp '1998-01-01')
    select hash, hash in (select tx_hash from live) as from_cache from tx""")
def _(v):
    predictions = v.anomalies.select(
        F.col("tx_hash").alias("hash"), F.lit(True).alias("is_anomaly"), "confidence",
        "anomaly_score", F.col("detected_at").alias("created_at"),
    )
    cached, missing = joins.split_by_cache(v.tx, predictions, AS_OF, 31_536_000)
    return cached.select("hash", F.lit(True).alias("from_cache")).unionByName(
        missing.select("hash", F.lit(False).alias("from_cache"))
    )


@query("J4_members_of", """
    select hash, value from tx where hash in (select tx_hash from anomalies where severity = 'critical')""")
def _(v):
    wanted = v.anomalies.where("severity = 'critical'").select(F.col("tx_hash").alias("hash"))
    return lookup.members_of(v.tx, wanted).select("hash", "value")


@query("J5_compare_metrics", """
    with m as (select version_id, metric, value from (
            select model_version_id as version_id, count(*)::double as n, avg(confidence) as conf,
                   avg(anomaly_score) as score from anomalies group by 1)
         unpivot (value for metric in (n, conf, score)))
    select a.metric, round(a.value, 6) as model1, round(b.value, 6) as model2,
           round(b.value - a.value, 6) as difference,
           round(case when a.value = 0 then 0 else (b.value - a.value) * 100 / a.value end, 6)
               as percent_change
    from m a join m b on a.metric = b.metric where a.version_id = 0 and b.version_id = 1""")
def _(v):
    per_version = v.anomalies.groupBy("model_version_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"),
        F.avg("anomaly_score").alias("score"),
    )
    both = joins.compare_metrics(
        per_version.where("model_version_id = 0"), per_version.where("model_version_id = 1"),
        ["n", "conf", "score"],
    )
    return both.select("metric", *[
        rounded(F.col(c)).alias(c) for c in ("model1", "model2", "difference", "percent_change")
    ])


def _bucketed(v, tx):
    name = f"tx_{uuid.uuid4().hex}"
    tables.save_bucketed(tx, name, new_path(v.spark, "bucketed"), tables.buckets_for(v.tx))
    return name


@query("A7_insert_into_buckets", """
    with firsts as (select hash, min(timestamp) as timestamp from tx group by 1),
    stored as (select hash from firsts where timestamp < timestamp '1996-01-01')
    select (select count(*) from firsts where hash not in (select hash from stored)) as inserted,
           (select count(*) from firsts) as rows, (select count(distinct hash) from tx) as hashes""")
def _(v):
    """Two batches into a table bucketed by hash; the second brings all rows, most of them stored already."""
    early = F.col("timestamp") < F.lit("1996-01-01").cast("timestamp")
    # A hash with an early row has one as its first, unless it has a row without time, which comes before.
    some = v.tx.where(early | F.col("timestamp").isNull())
    first = some.groupBy("hash").agg(F.min(F.struct("timestamp", *[c for c in v.tx.columns if c not in ("hash", "timestamp")])).alias("r"))
    buckets = tables.buckets_for(v.tx)
    with tables.filling(v.spark, buckets):
        name = _bucketed(v, first.select("hash", "r.*").select(*v.tx.columns).where(early))
    inserted = tables.insert_absent(v.tx.union(v.tx), name, rounds=tables.rounds_for(buckets))
    return v.spark.table(name).agg(
        F.lit(inserted).cast("bigint").alias("inserted"), F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("hashes"))


@query("J1_anomaly_with_bucketed_transaction", """
    select a.tx_hash, a.severity, t.value, t.gas, t.from_address, t.timestamp
    from anomalies a left join tx t on a.tx_hash = t.hash""")
def _(v):
    return joins.with_transaction(v.anomalies, v.spark.table(_bucketed(v, v.tx))).select(
        "tx_hash", "severity", "value", "gas", "from_address", "timestamp")


def _lookup_table(v):
    path = new_path(v.spark, "lookup")
    tables.write_lookup(v.tx, path, "year", distinct=20_000, group_bytes=256 << 10, files=8)
    return tables.read_transactions(v.spark, path).drop("period")


@query("Q1_by_hash_skipping", """
    select hash, from_address, value, timestamp from tx where hash = '0x' || md5('5979|1616|79|6')""")
def _(v):
    found = lookup.by_hash(_lookup_table(v), "0x" + hashlib.md5(b"5979|1616|79|6").hexdigest())
    return found.select("hash", "from_address", "value", "timestamp")


@query("Q2_by_address_skipping", f"""
    select hash, timestamp, value from tx
    where from_address = '{_address(42)}' or to_address = '{_address(42)}'
    order by timestamp desc, hash limit 50 offset 10""")
def _(v):
    return lookup.by_address(_lookup_table(v), _address(42), None, skip=10, limit=50).select("hash", "timestamp", "value")
