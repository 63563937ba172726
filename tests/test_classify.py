import hashlib
import json

from conftest import column
from pyspark.sql import functions as F

from ledgerwatch.functions import classify as cl
from ledgerwatch.functions.hashing import fingerprint, user_bucket


def one(frame, expression, **values):
    df = frame([tuple(values.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


def test_severity_is_strict(frame):
    cases = [(2_000_000, "critical"), (1_000_000, "high"), (150_000, "high"), (100_000, "medium"),
             (50_000, "medium"), (10_000, "low"), (1_000, "low")]
    df = frame([(float(v), 20.0, s) for v, s in cases] + [(None, None, "low"), (1.0, 100_001.0, "critical")],
               "value double, gas_price double, want string")
    got = df.select(cl.transaction_severity(F.col("value"), F.col("gas_price")).alias("got"), "want")
    assert all(r.got == r.want for r in got.collect())


def test_endpoint(frame):
    cases = {
        "/api/v1/models/abc123": "/api/v1/models/abc123", "/api/v1/transactions/0x123": "/api/v1/transactions/{hash}",
        "/users/42/": "/users/{id}", "/m/123e4567-e89b-12d3-a456-426614174000": "/m/{id}", "//": "/",
    }
    df = frame(list(cases.items()), "path string, want string")
    assert all(r.g == r.want for r in df.select(cl.endpoint(F.col("path")).alias("g"), "want").collect())


def test_request_and_audit_classes(frame):
    assert one(frame, cl.request_class(F.col("p")), p="/api/predict/batch") == "batch_predict"
    assert one(frame, cl.request_class(F.col("p")), p="/other") is None
    assert one(frame, cl.is_audited(F.col("m"), F.col("p")), m="GET", p="/admin/x") is True
    assert one(frame, cl.is_audited(F.col("m"), F.col("p")), m="GET", p="/tx") is False
    assert one(frame, cl.audit_action(F.col("m")), m="HEAD") == "head"
    assert one(frame, cl.audit_event_severity(F.col("t"), F.col("s")), t="auth", s="failure") == "warning"


def test_audit_line(frame):
    c = F.col
    line = cl.audit_line(c("a"), c("b"), c("u"), c("d"), c("e"), c("f"), c("g"))
    got = one(frame, line, a="info", b="data", u=None, d="read", e="/x", f="success", g="1.2.3.4")
    assert got == "[AUDIT] INFO | data | User:anonymous | read on /x | Status:success | IP:1.2.3.4"


def test_bucket_and_fingerprint(frame):
    wanted = {"user123": 87, "user1": 45, "user2": 32, "user3": 44, "0": 50, "1": 11, "42": 74, "149": 10}
    df = frame([(u, b) for u, b in wanted.items()], "u string, b int")
    assert df.where(user_bucket(F.col("u")) != F.col("b")).count() == 0
    params = {"b": "x", "a": "y z"}
    want = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()
    m = F.create_map(*[F.lit(x) for pair in params.items() for x in pair])
    assert column(frame([(1,)], "i int").select(fingerprint(m).alias("f")), "f") == [want]
    ints = F.create_map(F.lit("n"), F.lit(3), F.lit("k"), F.lit(1))
    want = hashlib.sha256(json.dumps({"n": 3, "k": 1}, sort_keys=True).encode()).hexdigest()
    assert column(frame([(1,)], "i int").select(fingerprint(ints).alias("f")), "f") == [want]
