"""Queries: routing and comparison of model versions."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.operators import routing

_BUCKET = """
    cast((((('0x' || substr(md5(user_id), 1, 16))::ubigint % 100) * 16
         + ('0x' || substr(md5(user_id), 17, 16))::ubigint % 100) % 100) as int)"""
_REQUESTS = f"""
    requests as (select id, user_id, cast(cast(user_id as bigint) % 5 as int) as model_id,
                        {_BUCKET} as bucket from request_log)"""
_RANGES = """
    ranges as (select model_id, id as version_id, traffic_percentage as traffic,
                      sum(traffic_percentage) over (partition by model_id order by traffic_percentage desc, id
                          rows unbounded preceding) as until,
                      row_number() over (partition by model_id order by traffic_percentage desc, id) as rank
               from model_versions where is_deployed)"""


def _requests(v):
    return v.request_log.select(
        "id", "user_id", (F.col("user_id").cast("bigint") % 5).cast("int").alias("model_id"))


@query("R1_version_decision", f"""
    with {_REQUESTS}
    select r.id, r.bucket, m.is_deployed and m.traffic_percentage > 0
           and (m.traffic_percentage >= 100 or r.bucket < m.traffic_percentage) as use_version
    from requests r, model_versions m where m.id = 4""")
def _(v):
    return routing.with_version_decision(_requests(v), v.model_versions, 4).select(
        "id", "bucket", "use_version")


@query("R2_route_split", f"""
    with {_REQUESTS}, {_RANGES}
    select r.id, r.bucket, g.version_id from requests r left join ranges g
    on r.model_id = g.model_id and r.bucket >= g.until - g.traffic and r.bucket < g.until""")
def _(v):
    return routing.route(_requests(v), v.model_versions).select("id", "bucket", "version_id")


@query("R2_route_reference", f"""
    with {_REQUESTS}, {_RANGES},
    top as (select model_id, count(*) as n, arg_min(version_id, rank) as version_id,
                   arg_min(traffic, rank) as traffic from ranges group by 1)
    select r.id, r.bucket,
           case when n > 1 or (traffic > 0 and r.bucket < traffic) then version_id end as version_id
    from requests r left join top on r.model_id = top.model_id""")
def _(v):
    return routing.route(_requests(v), v.model_versions, "reference").select(
        "id", "bucket", "version_id")


@query("W4_ranked_versions", f"""
    with {_RANGES} select model_id, version_id, traffic, rank, until from ranges""")
def _(v):
    return routing.ranked_versions(v.model_versions)


_METRICS = """
    m as (select model_version_id as id, count(*) as n, round(avg(confidence), 3) as c,
                 round(avg(anomaly_score), 3) as s,
                 count(*) filter (where severity in ('critical', 'high')) as severe
          from anomalies where detected_at between timestamp '1998-01-01' - interval 720 hours
                                               and timestamp '1998-01-01' group by 1)"""
_WINNER = """
    case when abs(coalesce(a.c, 0) - coalesce(b.c, 0)) > 0.05
              then case when coalesce(a.c, 0) > coalesce(b.c, 0) then 'model_a' else 'model_b' end
         when coalesce(a.severe, 0) <> coalesce(b.severe, 0)
              then case when coalesce(a.severe, 0) > coalesce(b.severe, 0) then 'model_a' else 'model_b' end
         when coalesce(a.n, 0) = coalesce(b.n, 0) then 'tie'
         when coalesce(a.n, 0) > coalesce(b.n, 0) then 'model_a' else 'model_b' end as winner"""
_SHOWN = """
    coalesce(a.n, 0) as total_anomalies_a, coalesce(a.c, 0)::double as avg_confidence_a,
    coalesce(a.s, 0)::double as avg_anomaly_score_a, coalesce(b.n, 0) as total_anomalies_b,
    coalesce(b.c, 0)::double as avg_confidence_b, coalesce(b.s, 0)::double as avg_anomaly_score_b"""


@query("R3_compare_versions", f"""
    with {_METRICS}
    select cast(1 as int) as version_a, cast(2 as int) as version_b, {_SHOWN}, {_WINNER}
    from (select 1) left join m a on a.id = 1 left join m b on b.id = 2""")
def _(v):
    return routing.compare_versions(v.anomalies, 1, 2, datetime(1998, 1, 1), 720)


@query("R3_compare_with_champion", f"""
    with {_METRICS}, pairs as (select distinct model_version_id as vb from anomalies)
    select cast(0 as int) as version_a, vb as version_b, {_SHOWN}, {_WINNER}
    from pairs left join m a on a.id = 0 left join m b on b.id = vb""")
def _(v):
    champions = v.anomalies.select("model_version_id").distinct().withColumn("champion_id", F.lit(0))
    return routing.compare_with_champion(v.anomalies, champions, datetime(1998, 1, 1), 720)
