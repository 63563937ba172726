"""Reads over stored tables: filters, pages, queues and bulk updates.

Every page has a total order, so that the same page is the same rows on every run. Sort and
limit together run as a distributed top-k; nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import SEVERITIES, severity_rank
from ledgerwatch.session import require_columns

# Fixed value: an address.
ADDRESS_PATTERN = "^0x[a-fA-F0-9]{40}$"
#: Hashes that are still a filter.
FILTER_HASHES = 1000


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of an order.

    Skipped rows come to one place, as in any paging by number; ``after`` (see ``page_after``)
    reads the next page of a large table without them. Without a limit the rows stay spread
    over the tasks, so ``skip`` needs one.
    """
    if skip and limit is None:
        raise ValueError("skip needs a limit; use page_after for the rest of a table")
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit must not be negative")
    ordered = df.orderBy(*order)
    if skip:
        ordered = ordered.offset(skip)
    return ordered if limit is None else ordered.limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a row, in an order of (column, ascending) pairs.

    ``last`` holds that row's values of the ordered columns (None for the first page). The
    condition reaches the scan, so the tenth million costs what the first page does. The
    columns must not be null and must tell all rows apart.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    beyond, same = F.lit(last is None), F.lit(True)
    for (name, ascending), value in zip(order, last or ()):
        col = F.col(name)
        beyond = beyond | (same & ((col > F.lit(value)) if ascending else (col < F.lit(value))))
        same = same & (col == F.lit(value))
    return df.where(beyond).orderBy(*[F.asc(n) if up else F.desc(n) for n, up in order]).limit(limit)


def list_rows(
    df: DataFrame, order_by: str | None = None, tie: str = "id", skip: int = 0, limit: int = 100,
) -> DataFrame:
    """A page ordered by a column descending when the table has it, else by the tie-break."""
    order = [F.desc(tie)]
    if order_by and order_by in df.columns:
        order.insert(0, F.desc(order_by))
    return page(df, order, skip, limit)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def by_hash(tx: DataFrame, tx_hash: str) -> DataFrame:
    return tx.where(F.col("hash") == tx_hash)


def by_address(
    tx: DataFrame, address: str, is_sender: bool | None = None, skip: int = 0, limit: int = 100,
) -> DataFrame:
    """Transactions sent by (True), received by (False) or touching (None) an address."""
    sent, received = F.col("from_address") == address, F.col("to_address") == address
    which = (sent | received) if is_sender is None else (sent if is_sender else received)
    return page(tx.where(which), [F.desc("timestamp"), F.asc("hash")], skip, limit)


def by_date_range(
    tx: DataFrame, start: datetime, end: datetime, skip: int = 0, limit: int | None = None,
) -> DataFrame:
    """Both ends included, oldest first."""
    kept = tx.where(F.col("timestamp").between(F.lit(start), F.lit(end)))
    return page(kept, [F.asc("timestamp"), F.asc("hash")], skip, limit)


def high_value(tx: DataFrame, minimum: float, limit: int = 100) -> DataFrame:
    return page(tx.where(F.col("value") >= minimum), [F.desc("value"), F.asc("hash")], 0, limit)


def by_hashes(tx: DataFrame, hashes: Iterable[str]) -> DataFrame:
    """Transactions with any of the hashes: few as a pushed-down filter, more as a join."""
    wanted = sorted(set(hashes))
    if not wanted:
        raise ValueError("no hashes given")
    if len(wanted) > FILTER_HASHES:
        return members_of(tx, tx.sparkSession.createDataFrame([(h,) for h in wanted], "hash string"))
    return tx.where(F.col("hash").isin(wanted))


def members_of(tx: DataFrame, wanted: DataFrame) -> DataFrame:
    """Transactions whose hash is in another table of any size. No hint: adaptive execution
    broadcasts the keys only when their measured size allows it."""
    return tx.join(wanted.select("hash"), "hash", "left_semi")


def lookup_totals(tx: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many distinct hashes were asked for and how many of them exist.

    The stored side is cut down to the wanted hashes before anything is made distinct.
    """
    asked = wanted.select("hash").distinct()
    stored = tx.select("hash").join(asked, "hash", "left_semi").distinct()
    return asked.join(stored.withColumn("_found", F.lit(1)), "hash", "left").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("_found").alias("found"),
    ).withColumn("missing", F.col("requested") - F.col("found"))


def account_dump(
    dump: DataFrame, address: str, start_block: int = 0, end_block: int = 99_999_999,
    sort: str = "asc",
) -> DataFrame:
    """The transactions of one account in a block range, from a landed dump."""
    import re

    if not re.match(ADDRESS_PATTERN, address or ""):
        raise ValueError(f"not an account address: {address}")
    if start_block < 0 or end_block < start_block:
        raise ValueError("block range must be ascending and not negative")
    if sort not in ("asc", "desc"):
        raise ValueError("sort must be asc or desc")
    require_columns(dump, "hash", "from_address", "to_address", "block_number")
    order = F.asc if sort == "asc" else F.desc
    touching = (F.col("from_address") == address) | (F.col("to_address") == address)
    return dump.where(
        touching & F.col("block_number").between(start_block, end_block)
    ).orderBy(order("block_number"), F.asc("hash"))


def valid_addresses(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).rlike(ADDRESS_PATTERN))


# -- anomalies ---------------------------------------------------------------------------


def anomalies_by_severity(
    anomalies: DataFrame, severity: str, key: str = "tx_hash", skip: int = 0, limit: int = 100,
) -> DataFrame:
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    kept = anomalies.where(F.col("severity") == severity)
    return page(kept, [F.desc("detected_at"), F.asc(key)], skip, limit)


def review_queue(anomalies: DataFrame, key: str = "tx_hash", limit: int = 100) -> DataFrame:
    """Unreviewed anomalies, worst first, then oldest first."""
    kept = anomalies.where(~F.col("reviewed"))
    order = [F.desc(severity_rank(F.col("severity"))), F.asc("detected_at"), F.asc(key)]
    return page(kept, order, 0, limit)


def recent_anomalies(
    anomalies: DataFrame, as_of: datetime, hours: int = 24, severity: str | None = None,
    key: str = "tx_hash", limit: int = 100,
) -> DataFrame:
    """Anomalies of the last hours before ``as_of``, newest first."""
    since = F.lit(as_of) - F.expr(f"interval {int(hours)} hours")
    kept = anomalies.where((F.col("detected_at") >= since) & (F.col("detected_at") <= F.lit(as_of)))
    if severity is not None:
        kept = kept.where(F.col("severity") == severity)
    return page(kept, [F.desc("detected_at"), F.asc(key)], 0, limit)


def by_model_version(
    anomalies: DataFrame, version: int, start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    kept = anomalies.where(F.col("model_version_id") == version)
    if start is not None:
        kept = kept.where(F.col("detected_at") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("detected_at") <= F.lit(end))
    return kept


def apply_reviews(anomalies: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Apply a table of review decisions (key, reviewer, is_false_positive, decided_at).

    The last decision per anomaly wins; the reduction to one row per key happens before the
    join, so a key with many decisions costs one row there.
    """
    require_columns(decisions, key, "reviewer", "is_false_positive", "decided_at")
    last = decisions.groupBy(key).agg(
        F.max(F.struct("decided_at", "reviewer", "is_false_positive")).alias("_last")
    )
    decided = F.col("_last").isNotNull()

    def choose(name: str, new: Column) -> Column:
        old = F.col(name) if name in anomalies.columns else F.lit(None).cast("string")
        return F.when(decided, new).otherwise(old)

    reviewed_at = (
        F.col("reviewed_at") if "reviewed_at" in anomalies.columns
        else F.lit(None).cast(decisions.schema["decided_at"].dataType)
    )
    return anomalies.join(last, key, "left").withColumns({
        "reviewed": F.when(decided, F.lit(True)).otherwise(F.col("reviewed")),
        "reviewed_by": choose("reviewed_by", F.col("_last.reviewer")),
        "reviewed_at": F.when(decided, F.col("_last.decided_at")).otherwise(reviewed_at),
        "false_positive": F.when(decided, F.col("_last.is_false_positive")).otherwise(
            F.col("false_positive")
        ),
    }).drop("_last")


# -- models ------------------------------------------------------------------------------


def deployed_versions(versions: DataFrame, model_id: int | None = None) -> DataFrame:
    kept = versions.where(F.col("is_deployed"))
    return kept if model_id is None else kept.where(F.col("model_id") == model_id)


def model_lineage(versions: DataFrame, model_id: int, created: str = "created_seq") -> DataFrame:
    """All versions of a model, newest first."""
    return versions.where(F.col("model_id") == model_id).orderBy(F.desc(created), F.desc("id"))


def latest_versions(versions: DataFrame, created: str = "created_seq") -> DataFrame:
    """The newest version of every model in one aggregate."""
    newest = F.max_by(F.struct("id", "version", "is_deployed"), F.struct(created, "id"))
    return versions.groupBy("model_id").agg(newest.alias("_v")).select("model_id", "_v.*")


def models_where(
    models: DataFrame, name: str | None = None, model_type: str | None = None,
    active: bool | None = None,
) -> DataFrame:
    for column, wanted in (("name", name), ("model_type", model_type), ("is_active", active)):
        if wanted is not None:
            models = models.where(F.col(column) == wanted)
    return models


# -- audit and users ---------------------------------------------------------------------


def audit_rows(
    logs: DataFrame, event_type: str | None = None, user_id: str | None = None,
    severity: str | None = None, start: datetime | None = None, end: datetime | None = None,
    skip: int = 0, limit: int = 100, order: str = "desc",
) -> DataFrame:
    """The newest matching rows, returned newest first or oldest first."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    for column, wanted in (("event_type", event_type), ("user_id", user_id), ("severity", severity)):
        if wanted is not None:
            logs = logs.where(F.col(column) == wanted)
    if start is not None:
        logs = logs.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        logs = logs.where(F.col("timestamp") <= F.lit(end))
    newest = page(logs, [F.desc("timestamp"), F.desc("id")], skip, limit)
    return newest if order == "desc" else newest.orderBy(F.asc("timestamp"), F.asc("id"))


def users_where(
    users: DataFrame, email: str | None = None, active: bool | None = None, role: str | None = None,
) -> DataFrame:
    if email is not None:
        users = users.where(F.col("email") == email)
    if active is not None:
        users = users.where(F.col("is_active") == active)
    if role is not None:
        users = users.where(F.array_contains("roles", role))
    return users
