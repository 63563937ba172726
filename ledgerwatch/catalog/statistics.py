"""Queries: aggregates and the data behind plots."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.functions.numeric import rounded
from ledgerwatch.operators import stats


@query("G1_transaction_statistics", """
    select count(*) as total_transactions, round(sum(value), 2) as total_value,
           round(avg(value), 4) as avg_value, max(value) as max_value, min(value) as min_value,
           round(avg(gas_price), 4) as avg_gas_price
    from tx""")
def _(v):
    return stats.transaction_statistics(v.tx).withColumns({
        "total_value": rounded(F.col("total_value"), 2), "avg_value": rounded(F.col("avg_value"), 4),
        "avg_gas_price": rounded(F.col("avg_gas_price"), 4),
    })


@query("G1_statistics_since", """
    select count(*) as total_transactions, round(coalesce(sum(value), 0), 2) as total_value,
           max(value) as max_value
    from tx where timestamp >= timestamp '1999-01-01'""")
def _(v):
    return stats.transaction_statistics(v.tx, datetime(1999, 1, 1)).select(
        "total_transactions", rounded(F.col("total_value"), 2).alias("total_value"), "max_value")


@query("G2_false_positive_rate", """
    select count(*) filter (where reviewed) as reviewed,
           count(*) filter (where reviewed and false_positive) as false_positives,
           round(count(*) filter (where reviewed and false_positive) / count(*) filter (where reviewed), 6)
               as false_positive_rate
    from anomalies where detected_at >= timestamp '1996-01-01'""")
def _(v):
    return stats.false_positive_rate(v.anomalies, datetime(1996, 1, 1)).withColumn(
        "false_positive_rate", rounded(F.col("false_positive_rate")))


@query("G3_review_precision", """
    select model_version_id, count(*) filter (where reviewed) as reviewed,
           round(count(*) filter (where reviewed and not coalesce(false_positive, false))
                 / count(*) filter (where reviewed), 6) as precision
    from anomalies group by 1""")
def _(v):
    return stats.review_precision(v.anomalies).withColumn("precision", rounded(F.col("precision")))


@query("G4_severity_distribution", "select severity, count(*) as n from anomalies group by severity")
def _(v):
    return stats.severity_distribution(v.anomalies)


@query("G5_model_metrics", """
    select model_version_id, count(*) as total_anomalies, round(avg(confidence), 3) as avg_confidence,
           round(avg(anomaly_score), 3) as avg_anomaly_score,
           count(*) filter (where severity = 'low') as n_low,
           count(*) filter (where severity = 'medium') as n_medium,
           count(*) filter (where severity = 'high') as n_high,
           count(*) filter (where severity = 'critical') as n_critical
    from anomalies group by 1""")
def _(v):
    return stats.model_metrics(v.anomalies)


@query("G6_audit_statistics", """
    select case when grouping(event_type) = 0 then 'event_type' when grouping(severity) = 0 then 'severity'
                else 'total' end as kind,
           case when grouping(event_type) = 0 then event_type when grouping(severity) = 0 then severity
                else 'all' end as name,
           count(*) as n, count(*) filter (where status = 'failure') as failures,
           min(timestamp) as oldest, max(timestamp) as newest
    from audit_logs group by grouping sets ((), (event_type), (severity))""")
def _(v):
    return stats.audit_statistics(v.audit_logs)


@query("G7_batch_summary", """
    with r as (select t.hash, coalesce(t.value > 95000, false) as is_anomaly,
                      t.hash in (select tx_hash from anomalies) as from_cache from tx t)
    select count(*) as total_processed, count(*) filter (where is_anomaly) as total_anomalies,
           count(*) filter (where from_cache) as from_cache,
           count(*) filter (where not from_cache) as computed
    from r""")
def _(v):
    known = v.anomalies.select(F.col("tx_hash").alias("hash")).distinct().withColumn("k", F.lit(True))
    results = v.tx.select("hash", (F.col("value") > 95000).alias("is_anomaly")).join(
        known, "hash", "left"
    ).withColumn("from_cache", F.coalesce("k", F.lit(False)))
    return stats.batch_summary(results)


@query("G8_hit_rates", """
    select event_type as kind, count(*) filter (where value <= 100) as hits,
           count(*) filter (where value > 100) as misses,
           round(count(*) filter (where value <= 100) * 100 / count(*), 2) as hit_rate
    from events group by 1""")
def _(v):
    return stats.hit_rates(v.events, "event_type", F.col("value") <= 100)


@query("G9_buffer_statistics", """
    with live as (select detected_at as t from anomalies
                  where detected_at <= timestamp '1998-01-01'
                    and detected_at >= timestamp '1998-01-01' - interval 86400 seconds * 30
                  order by t desc limit 200),
         k as (select count(*) as n, min(t) as oldest, max(t) as newest from live),
         i as (select count(*) as n from anomalies where detected_at <= timestamp '1998-01-01')
    select k.n as current_size, cast(200 as bigint) as max_size,
           cast(2592000 as bigint) as ttl_seconds, i.n as total_inserted,
           i.n - k.n as total_evicted, k.n / 200.0e0 as utilization,
           epoch(timestamp '1998-01-01' - oldest)::double as oldest_age_seconds,
           epoch(timestamp '1998-01-01' - newest)::double as newest_age_seconds,
           k.n * 1024 as current_bytes, round(k.n * 1024 / 1048576.0e0, 2) as current_mb,
           cast(200 * 1024 as bigint) as max_bytes, 0.2::double as max_mb
    from k, i""")
def _(v):
    return stats.buffer_statistics(v.anomalies, datetime(1998, 1, 1), 200, 2_592_000)


@query("G10_traffic_allocation", """
    select model_id, id as version_id, version, traffic_percentage,
           count(*) over (partition by model_id) as total_versions,
           sum(traffic_percentage) over (partition by model_id) as traffic_allocated
    from model_versions where is_deployed""")
def _(v):
    return stats.traffic_allocation(v.model_versions)


@query("G11_consumer_lag", """
    with o as (select event_type as topic, cast(user_id % 4 as int) as partition,
                      max(event_id) as end_offset,
                      max(case when value <= 100 then event_id end) as position
               from events group by 1, 2),
         p as (select topic, partition, greatest(end_offset - position, 0) as lag from o)
    select topic, partition, lag from p
    union all select topic, -1, cast(sum(lag) as bigint) from p group by topic""")
def _(v):
    offsets = v.events.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("end_offset"),
        F.when(F.col("value") <= 100, F.col("event_id")).alias("position"),
    )
    return stats.consumer_lag(offsets)


@query("G12_histogram", """
    with b as (select min(value) as lo, max(value) as hi, (max(value) - min(value)) / 20 as step from tx),
         c as (select cast(list_sum(list_transform(range(1, 20),
                      lambda i: case when value >= lo + i * step then 1 else 0 end)) as int) as bin,
                      count(*) as n
               from tx, b group by 1)
    select cast(s.bin as int) as bin, round(lo + s.bin * step, 6) as bin_start,
           round(lo + (s.bin + 1) * step, 6) as bin_end, coalesce(c.n, 0) as n
    from range(20) s(bin) cross join b left join c on c.bin = s.bin""")
def _(v):
    return stats.histogram(v.tx, "value", 20).withColumns({
        c: rounded(F.col(c)) for c in ("bin_start", "bin_end")})


@query("G12_plot_series", """
    select date_trunc('day', timestamp) as bucket, count(*) as n, min(value) as low,
           round(avg(value), 7) as mean, max(value) as high
    from tx group by 1""")
def _(v):
    return stats.plot_series(v.tx).withColumn("mean", rounded(F.col("mean"), 7))


@query("G12_plot_labelled_series", """
    select date_trunc('month', timestamp) as bucket,
           case when value > 95000 then 'anomaly' else 'normal' end as anomaly,
           count(*) as n, min(value) as low, round(avg(value), 7) as mean, max(value) as high
    from tx group by 1, 2""")
def _(v):
    labelled = v.tx.withColumn("anomaly", F.when(F.col("value") > 95000, "anomaly").otherwise("normal"))
    return stats.plot_labelled_series(labelled, bucket="month").withColumn(
        "mean", rounded(F.col("mean"), 7))
