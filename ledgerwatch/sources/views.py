"""Transaction, anomaly, audit, request, model and metric tables over the test data.

Each view is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TX_HASH = (
    "'0x' || md5(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(l_linenumber as string)))"
)

_RAW_COLUMNS = """
    '0x' || md5(cast(event_id as string)) as hash, cast(user_id as string) as from_address,
    case when event_id % 17 = 0 then null when event_id % 23 = 0 then 'invalid'
         when event_id % 29 = 0 then '-5'
         else cast(cast(round(value * 100) as bigint) as string) end as value,
    case when event_id % 31 = 0 then null
         else cast(21000 + 100 * cast(regexp_extract(props, '([0-9]+)', 1) as int) as string)
         end as gas,
    cast(20 + event_id % 80 as string) as gas_price,
    case when event_id % 37 = 0 then 'bad'
         else cast(1704067200 + event_id * 250 as string) end as time_stamp
"""

VIEW_SQL = {
    "tx": f"""
        select {_TX_HASH} as hash, l_orderkey as block_number, l_shipdate as timestamp,
               '0x' || md5(cast(o_custkey as string)) as from_address,
               '0x' || md5(cast(l_suppkey as string)) as to_address,
               l_extendedprice as value, 21000.0e0 + l_quantity * 1000 as gas,
               o_totalprice / 4 as gas_price
        from lineitem join orders on l_orderkey = o_orderkey""",
    "tx_raw": f"""
        select {_RAW_COLUMNS} from events
        union all
        select {_RAW_COLUMNS} from events where event_id % 10 = 0""",
    "anomalies": f"""
        select {_TX_HASH} as tx_hash, cast(l_suppkey % 4 as int) as model_version_id,
               -(0.5e0 + l_discount) as anomaly_score, 0.5e0 + l_discount as confidence,
               case when l_extendedprice > 100000 then 'critical'
                    when l_extendedprice > 90000 then 'high'
                    when l_extendedprice > 75000 then 'medium' else 'low' end as severity,
               l_shipdate as detected_at, l_linestatus = 'F' as reviewed,
               case when l_linestatus = 'F' and l_linenumber < 7 then l_returnflag = 'R' end
                   as false_positive
        from lineitem where l_extendedprice > 60000""",
    "audit_logs": """
        select event_id as id,
               case event_type when 'error' then 'admin' when 'signup' then 'auth'
                    else 'data' end as event_type,
               cast(user_id as string) as user_id,
               case when event_type = 'error' then 'failure' when event_id % 11 = 0 then 'denied'
                    else 'success' end as status,
               case when event_type = 'error' and value > 100 then 'error'
                    when event_type = 'error' then 'warning' else 'info' end as severity,
               ts as timestamp
        from events""",
    "request_log": """
        select event_id as id, '10.0.0.' || cast(user_id as string) as ip,
               cast(user_id as string) as user_id,
               case event_type when 'signup' then 'POST' when 'error' then 'DELETE'
                    when 'purchase' then 'PUT' else 'GET' end as method,
               case event_type when 'signup' then '/api/v1/auth/login'
                    when 'purchase' then '/api/v1/predict/batch'
                    when 'view' then '/api/v1/transactions/0x' || md5(cast(event_id as string))
                    when 'click' then '/api/v1/models/' || cast(user_id as string)
                    else '/api/v1/predict' end as path,
               case when event_type = 'error' and event_id % 2 = 0 then 500
                    when event_type = 'error' then 404 else 200 end as status_code,
               value / 100 as duration_s, ts
        from events""",
    "model_versions": """
        select cast(s_suppkey as int) as id, cast(s_suppkey % 5 as int) as model_id,
               '1.0.' || cast(cast(floor(s_suppkey / 5) as bigint) as string) as version,
               s_suppkey % 3 <> 0 as is_deployed,
               cast((s_suppkey * 17) % 101 as double) as traffic_percentage,
               s_suppkey as created_seq
        from supplier""",
    "scored": """
        select event_id, user_id, case when event_type = 'error' then 1 else 0 end as y_true,
               case when value > 200 then 1 else 0 end as y_pred, value as score
        from events""",
    "metrics": """
        select event_type as metric_name, value as metric_value,
               cast(user_id % 4 as int) as instance, ts as timestamp
        from events""",
}

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Views:
    """Lazy access to the views and the stored tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            text = VIEW_SQL[name]
            used = {t: self.table(t) for t in _TABLES if re.search(rf"\b{t}\b", text)}
            for table in used:
                text = re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", text)
            return self.spark.sql(text, **used)
        if name in _TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Put the views that a query names in front of it, for DuckDB."""
    used = [name for name in VIEW_SQL if re.search(rf"\b{name}\b", sql)]
    ctes = ",\n".join(f"{name} as ({VIEW_SQL[name]})" for name in used)
    body = sql.strip()
    if not used:
        return body
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"with {ctes}\n{body}"
