"""Queries: scans, cleaning, classification."""

from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.functions import classify as cl
from ledgerwatch.functions.features import with_model_features
from ledgerwatch.functions.hashing import fingerprint, user_bucket
from ledgerwatch.functions.numeric import as_double, rounded
from ledgerwatch.operators import clean as op
from ledgerwatch.operators.lookup import account_dump, valid_addresses
from ledgerwatch.session import new_path
from ledgerwatch.sources import tables
from ledgerwatch.streaming.parse import good_records, rejected_records, validate

_TYPED = (
    "hash, from_address, try_cast(value as double) as value, try_cast(gas as double) as gas, "
    "try_cast(gas_price as double) as gas_price"
)
_TIME = "make_timestamp(try_cast(time_stamp as bigint) * 1000000)"


def _typed(v):
    return v.tx_raw.select(
        "hash", "from_address",
        *[as_double(F.col(c)).alias(c) for c in ("value", "gas", "gas_price")],
    )


@query("A1_typed_scan", f"select {_TYPED}, {_TIME} as timestamp from tx_raw")
def _(v):
    return tables.typed_transactions(v.tx_raw)


@query("A2_account_dump", """
    with dump as (
        select hash, block_number, rpad(from_address, 42, '0') as from_address, to_address, value
        from tx)
    select * from dump
    where from_address = rpad('0x' || md5('370'), 42, '0') and block_number between 10 and 1000000
      and regexp_matches(from_address, '^0x[a-fA-F0-9]{40}$')
    order by block_number, hash""")
def _(v):
    import hashlib

    dump = v.tx.select(
        "hash", "block_number", F.rpad("from_address", 42, "0").alias("from_address"),
        "to_address", "value",
    )
    account = ("0x" + hashlib.md5(b"370").hexdigest()).ljust(42, "0")
    return account_dump(valid_addresses(dump, "from_address"), account, 10, 1_000_000)


@query("A6_append_count", "select count(*) as returned, count(*) as stored from tx")
def _(v):
    """The number that an append returns is the number of rows it stored."""
    path = new_path(v.spark, "transactions")
    returned = tables.append_transactions(v.tx, path, grain="year")
    return tables.read_transactions(v.spark, path, grain="year").agg(
        F.lit(returned).cast("bigint").alias("returned"), F.count(F.lit(1)).alias("stored"))


@query("A6_append_read_back", """
    select strftime(timestamp, '%Y') as period, count(*) as n, round(sum(value), 2) as total,
           min(hash) as first_hash
    from tx where timestamp between timestamp '1996-03-01' and timestamp '1999-06-30' group by 1""")
def _(v):
    from datetime import datetime

    path = new_path(v.spark, "transactions")
    tables.append_transactions(v.tx, path, grain="year")
    back = tables.read_transactions(
        v.spark, path, datetime(1996, 3, 1), datetime(1999, 6, 30), grain="year"
    )
    return back.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"),
        F.min("hash").alias("first_hash"),
    )


@query("A7_insert_if_absent", """
    with stored as (select hash from tx where timestamp < timestamp '1997-01-01'),
         fresh as (select hash, min(timestamp) as timestamp, min(value) as value from tx group by hash)
    select hash, timestamp, value from fresh where hash not in (select hash from stored)""")
def _(v):
    batch = v.tx.select("hash", "timestamp", "value")
    stored = v.tx.where(F.col("timestamp") < F.lit("1997-01-01").cast("timestamp"))
    return tables.absent_rows(batch.unionByName(batch), stored)


@query("C1_drop_duplicates", "select distinct * from tx_raw")
def _(v):
    return op.drop_duplicate_rows(v.tx_raw)


@query("C2_fill_missing", """
    select hash, from_address, coalesce(try_cast(value as double), 0) as value,
           coalesce(try_cast(gas as double), 0) as gas, try_cast(gas_price as double) as gas_price
    from tx_raw""")
def _(v):
    return op.fill_missing(_typed(v))


@query("C3_keep_valid", """
    select hash, try_cast(value as double) as value, gas from tx_raw
    where try_cast(value as double) > 0 and not isnan(try_cast(value as double))""")
def _(v):
    return op.keep_valid(v.tx_raw.select("hash", "value", "gas"))


@query("C4_clean", f"""
    with typed as (select distinct {_TYPED} from tx_raw),
         filled as (select hash, from_address, coalesce(value, 0) as value,
                           coalesce(gas, 0) as gas, coalesce(gas_price, 0) as gas_price from typed)
    select * from filled where value > 0 and not isnan(value)""")
def _(v):
    return op.clean(_typed(v))


@query("C5_convert_timestamp", f"select hash, {_TIME} as time_stamp from tx_raw")
def _(v):
    return op.convert_timestamp(v.tx_raw.select("hash", "time_stamp"), "time_stamp")


@query("C5_failed_timestamps", f"""
    select count(*) as total, cast(count(*) filter (where {_TIME} is null) as bigint) as failed
    from tx_raw""")
def _(v):
    return op.failed_timestamps(v.tx_raw, "time_stamp")


@query("C6_min_max_scale", """
    with b as (select min(value) v0, max(value) v1, min(gas) g0, max(gas) g1,
                      min(gas_price) p0, max(gas_price) p1 from tx)
    select hash, round((value - v0) / (v1 - v0), 6) as value, round((gas - g0) / (g1 - g0), 6) as gas,
           round((gas_price - p0) / (p1 - p0), 6) as gas_price
    from tx, b""")
def _(v):
    scaled = op.min_max_scale(v.tx, ["value", "gas", "gas_price"])
    return scaled.select("hash", *[rounded(F.col(c)).alias(c) for c in ("value", "gas", "gas_price")])


@query("C7_transform", f"""
    with typed as (select hash, {_TIME} as time_stamp,
                          try_cast(value as double) as value from tx_raw),
         b as (select min(value) as lo, max(value) as hi from typed)
    select hash, time_stamp, round((value - lo) / (hi - lo), 6) as value from typed, b""")
def _(v):
    done = op.transform(v.tx_raw.select("hash", "time_stamp", "value"), "time_stamp")
    return done.withColumn("value", rounded(F.col("value")))


@query("C8_model_features", """
    select hash, round(value / (gas + 1e-10), 6) as value_per_gas,
           cast(hour(timestamp) as int) as hour_of_day,
           cast(isodow(timestamp) - 1 as int) as day_of_week
    from tx""")
def _(v):
    return with_model_features(v.tx).select(
        "hash", rounded(F.col("value_per_gas")).alias("value_per_gas"), "hour_of_day", "day_of_week"
    )


def _records(v):
    return v.tx_raw.select(
        "hash", "value", "gas", F.col("gas_price").alias("gasPrice"), F.col("from_address").alias("from")
    )


_REASON = """
    case when hash is null then 'missing hash' when value is null then 'missing value'
         when gas is null then 'missing gas' when gas_price is null then 'missing gasPrice'
         when try_cast(value as double) is null then 'invalid value'
         when try_cast(gas as double) is null then 'invalid gas'
         when try_cast(gas_price as double) is null then 'invalid gasPrice' end"""


@query("C9_good_records", f"""
    select hash, try_cast(value as double) as value, try_cast(gas as double) as gas,
           try_cast(gas_price as double) as "gasPrice", from_address as "from", '' as "to",
           cast(0 as bigint) as "blockNumber"
    from tx_raw where {_REASON} is null""")
def _(v):
    return good_records(validate(_records(v))).drop("timestamp")


@query("C9_rejected_records", f"""
    select reason, count(*) as n from (select {_REASON} as reason from tx_raw)
    where reason is not null group by reason""")
def _(v):
    return rejected_records(validate(_records(v))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("C10_range_checks", f"""
    select hash, case when value < 0 then 'value below zero' when gas < 0 then 'gas below zero'
                      when gas_price < 0 then 'gas_price below zero' end as violation
    from (select {_TYPED} from tx_raw)""")
def _(v):
    checked = [(c, F.col(c)) for c in ("value", "gas", "gas_price")]
    return _typed(v).select("hash", cl.range_violation(*checked).alias("violation"))


_SEVERITY = """
    case when value > 1000000 or gas_price > 100000 then 'critical'
         when value > 100000 or gas_price > 50000 then 'high'
         when value > 10000 or gas_price > 10000 then 'medium' else 'low' end"""


@query("C11_severity", f"select hash, {_SEVERITY} as severity from tx")
def _(v):
    return v.tx.select(
        "hash", cl.transaction_severity(F.col("value"), F.col("gas_price")).alias("severity")
    )


@query("C12_endpoint", """
    select id, '/' || array_to_string(list_transform(
        list_filter(string_split(path, '/'), lambda x: x <> ''),
        lambda x: case when length(x) = 36 and length(x) - length(replace(x, '-', '')) = 4 then '{id}'
                       when starts_with(x, '0x') then '{hash}'
                       when regexp_full_match(x, '[0-9]+') then '{id}' else x end), '/') as endpoint
    from request_log""")
def _(v):
    return v.request_log.select("id", cl.endpoint(F.col("path")).alias("endpoint"))


_CLASS = """
    case when contains(path, '/predict/batch') then 'batch_predict'
         when contains(path, '/predict') then 'predict' when contains(path, '/train') then 'train'
         when contains(path, '/auth') then 'auth' end"""


@query("C13_request_class", f"select id, {_CLASS} as request_class from request_log")
def _(v):
    return v.request_log.select("id", cl.request_class(F.col("path")).alias("request_class"))


_ACTION = """
    case method when 'POST' then 'create' when 'GET' then 'read' when 'PUT' then 'update'
                when 'PATCH' then 'update' when 'DELETE' then 'delete' else lower(method) end"""
_AUDITED = """
    method in ('POST', 'PUT', 'PATCH', 'DELETE')
    or (method = 'GET' and (contains(path, '/users/') or contains(path, '/admin/')
                            or contains(path, '/api-keys/')))"""
_REQUEST_SEVERITY = "case when status_code >= 500 then 'error' else 'info' end"
_REQUEST_STATUS = "case when status_code < 400 then 'success' else 'failure' end"


def _audited(v):
    return v.request_log.where(cl.is_audited(F.col("method"), F.col("path"))).select(
        "id", "user_id", "ip", "path",
        cl.audit_action(F.col("method")).alias("action"),
        cl.audit_status(F.col("status_code")).alias("status"),
        cl.audit_request_severity(F.col("status_code")).alias("severity"),
    )


@query("C14_audit_classification", f"""
    select id, {_ACTION} as action, {_REQUEST_STATUS} as status, {_REQUEST_SEVERITY} as severity
    from request_log where {_AUDITED}""")
def _(v):
    return _audited(v).select("id", "action", "status", "severity")


@query("C15_audit_severity", """
    select id, case when event_type = 'admin' then 'warning'
                    when event_type = 'auth' and status = 'failure' then 'warning'
                    else 'info' end as severity
    from audit_logs""")
def _(v):
    return v.audit_logs.select(
        "id", cl.audit_event_severity(F.col("event_type"), F.col("status")).alias("severity")
    )


@query("C16_audit_line", f"""
    select id, '[AUDIT] ' || upper({_REQUEST_SEVERITY}) || ' | api | User:' ||
           case when coalesce(user_id, '') <> '' then user_id else 'anonymous' end || ' | ' ||
           {_ACTION} || ' on ' || path || ' | Status:' || {_REQUEST_STATUS} || ' | IP:' || ip as line
    from request_log where {_AUDITED}""")
def _(v):
    c = F.col
    return _audited(v).select("id", cl.audit_line(
        c("severity"), F.lit("api"), c("user_id"), c("action"), c("path"), c("status"), c("ip")
    ).alias("line"))


@query("C17_fingerprint", """
    select id, sha256('{"id": "' || cast(id as string) || '", "model_id": "' ||
                      cast(model_id as string) || '", "version": "' || version || '"}') as fingerprint
    from model_versions""")
def _(v):
    params = F.create_map(
        F.lit("version"), F.col("version"), F.lit("id"), F.col("id").cast("string"),
        F.lit("model_id"), F.col("model_id").cast("string"),
    )
    return v.model_versions.select("id", fingerprint(params).alias("fingerprint"))


@query("C18_user_bucket", """
    select id, cast((((('0x' || substr(md5(user_id), 1, 16))::ubigint % 100) * 16
                      + ('0x' || substr(md5(user_id), 17, 16))::ubigint % 100) % 100) as int) as bucket
    from request_log""")
def _(v):
    return v.request_log.select("id", user_bucket(F.col("user_id")).alias("bucket"))


@query("B1_batch_pipeline", f"""
    with typed as (select distinct hash, {_TIME} as moment, try_cast(value as double) as value, try_cast(gas as double) as gas,
                          try_cast(gas_price as double) as gas_price from tx_raw),
         kept as (select * from typed where value > 0 and not isnan(value)),
         scaled as (select cast(moment as date) as day, (value - min(value) over ()) / (max(value) over () - min(value) over ()) as value
                    from kept),
         daily as (select day, sum(value) as total from scaled where day is not null group by 1)
    select (select count(*) from kept) as rows, (select cast(floor((count(*) - 1) * 0.01e0) as bigint) + 1 from kept) as anomalies,
           cast(case when date_diff('day', min(day), max(day)) + 1 >= 6 then 10 else 0 end as bigint) as steps, cast(date_diff('day', min(day), max(day)) + 1 as bigint) as days,
           round(sum(total), 4) as total from daily""")
def _(v):
    """Clean, transform, detect, forecast and plot data as one flow."""
    from ledgerwatch.plans.flagship import batch_pipeline

    raw = v.tx_raw.select("hash", "time_stamp", *[as_double(F.col(c)).alias(c) for c in ("value", "gas", "gas_price")])
    done = batch_pipeline(raw)
    real = F.when(F.col("n") > 0, F.col("value"))
    counted = done.labelled.groupBy(F.to_date("time_stamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return done.plot.join(counted, "day", "left").agg(
        F.lit(done.labelled.count()).cast("bigint").alias("rows"),
        F.lit(done.labelled.where("anomaly = 'anomaly'").count()).cast("bigint").alias("anomalies"),
        F.lit(done.forecast.count()).cast("bigint").alias("steps"), F.count(F.lit(1)).alias("days"),
        rounded(F.sum(real), 4).alias("total"))
