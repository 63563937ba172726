"""Labels for transactions, requests and audit events, as expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order, worst last.
SEVERITIES = ("low", "medium", "high", "critical")

# Severity, value above, gas price above.
SEVERITY_RULES = (
    ("critical", 1_000_000, 100_000),
    ("high", 100_000, 50_000),
    ("medium", 10_000, 10_000),
)

# Text in the request path and the request class, first match wins.
REQUEST_CLASSES = (
    ("/predict/batch", "batch_predict"),
    ("/predict", "predict"),
    ("/train", "train"),
    ("/auth", "auth"),
)

# HTTP method and audit action.
METHOD_ACTIONS = {
    "POST": "create",
    "GET": "read",
    "PUT": "update",
    "PATCH": "update",
    "DELETE": "delete",
}

# Methods that change data, and paths whose reads are audited as well.
MUTATIONS = ("POST", "PUT", "PATCH", "DELETE")
AUDITED_READS = ("/users/", "/admin/", "/api-keys/")


def severity_rank(col: Column) -> Column:
    """Position of a severity name; sorting by the name itself would be wrong."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(col == name, F.lit(i)).otherwise(rank)
    return rank


def transaction_severity(value: Column, gas_price: Column) -> Column:
    """Severity by value or gas price; comparisons are strict and null is never greater."""
    label = F.lit("low")
    for name, value_limit, price_limit in reversed(SEVERITY_RULES):
        label = F.when((value > value_limit) | (gas_price > price_limit), name).otherwise(label)
    return label


def range_violation(*named: tuple[str, Column]) -> Column:
    """Name of the first column below zero, null when all are fine."""
    return F.coalesce(*[F.when(col < 0, F.lit(f"{name} below zero")) for name, col in named])


def endpoint(path: Column) -> Column:
    """A request path with ids and hashes replaced by placeholders."""

    def part(text: Column) -> Column:
        dashes = F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))
        return (
            F.when((F.length(text) == 36) & (dashes == 4), "{id}")
            .when(text.startswith("0x"), "{hash}")
            .when(text.rlike("^[0-9]+$"), "{id}")
            .otherwise(text)
        )

    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, part), "/"))


def request_class(path: Column) -> Column:
    """Limit class of a request path, null for other paths."""
    label = F.lit(None).cast("string")
    for text, name in reversed(REQUEST_CLASSES):
        label = F.when(path.contains(text), name).otherwise(label)
    return label


def audit_action(method: Column) -> Column:
    action = F.lower(method)
    for name, verb in METHOD_ACTIONS.items():
        action = F.when(method == name, verb).otherwise(action)
    return action


def audit_status(status_code: Column) -> Column:
    return F.when(status_code < 400, "success").otherwise("failure")


def audit_request_severity(status_code: Column) -> Column:
    return F.when(status_code >= 500, "error").otherwise("info")


def is_audited(method: Column, path: Column) -> Column:
    """Mutations always, reads only below the audited paths."""
    read = F.lit(False)
    for text in AUDITED_READS:
        read = read | path.contains(text)
    return method.isin(*MUTATIONS) | ((method == "GET") & read)


def audit_event_severity(event_type: Column, status: Column) -> Column:
    """Admin events and failed authentications warn, the rest informs."""
    return (
        F.when(event_type == "admin", "warning")
        .when((event_type == "auth") & (status == "failure"), "warning")
        .otherwise("info")
    )


def audit_line(severity, event_type, user_id, action, resource, status, ip) -> Column:
    """One log line; a missing or empty user is shown as anonymous."""
    # Fixed value: the format of the line.
    user = F.when(F.coalesce(user_id, F.lit("")) != "", user_id).otherwise("anonymous")
    return F.format_string(
        "[AUDIT] %s | %s | User:%s | %s on %s | Status:%s | IP:%s",
        F.upper(severity), event_type, user, action, resource, status, ip,
    )
