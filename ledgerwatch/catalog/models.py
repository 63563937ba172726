"""Queries: forest fitting, scoring, tuning, storage, retraining."""

import uuid
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.functions.features import BASE_FEATURES, value_per_gas
from ledgerwatch.functions.numeric import rounded
from ledgerwatch.operators import extras, forest, joins
from ledgerwatch.operators.evaluate import anomaly_evaluation
from ledgerwatch.session import materialise, new_path, python_tasks, spread
from ledgerwatch.sources import tables

PREDICT_FEATURES = (*BASE_FEATURES, "value_per_gas")


def _tx(v, *more: str):
    """The columns a model needs, spread if they come in few files."""
    return spread(v.tx.select("hash", *BASE_FEATURES, *more), "hash")


def _fixed_model() -> forest.Forest:
    """Two trees of two levels that SQL can walk; the last feature is in neither."""
    return forest.Forest(
        BASE_FEATURES, 4, 0.1, 1, np.array([[0, 1, 0], [1, 0, 1]], np.int32),
        np.array([[30_000.0, 40_000.0, 60_000.0], [45_000.0, 20_000.0, 50_000.0]]),
        np.array([[1.5, 2.0, 3.0, 1.0], [2.5, 1.0, 3.5, 0.5]]), threshold=-0.62)


# The same walk in SQL; 4 rows to a tree have an expected path of 2 (ln 3 + gamma) - 1.5.
_WALK = """
    walked as (select *, -pow(2, -(
        case when value <= 30000 then case when gas <= 40000 then 1.5 else 2.0 end
             else case when value <= 60000 then 3.0 else 1.0 end end
        + case when gas <= 45000 then case when value <= 20000 then 2.5 else 1.0 end
               else case when gas <= 50000 then 3.5 else 0.5 end end) / 2
        / (2 * (ln(3) + 0.5772156649015329) - 1.5)) as score from tx)"""


def _with_ratio(tx):
    return tx.withColumn("value_per_gas", value_per_gas(F.col("value"), F.col("gas")))


@query("M1_fit_nodes")
def _(v):
    total = v.tx.count()
    return forest.tree_nodes(v.tx, BASE_FEATURES, [forest.Spec()], 42, "hash", total)


@query("M1_rows_per_tree", """
    select cast(tree as int) as tree, cast(least(256, n) as bigint) as root_rows,
           cast(least(256, n) as bigint) as leaf_rows
    from range(100) t(tree), (select count(*) as n from tx)""")
def _(v):
    nodes = forest.tree_nodes(v.tx, BASE_FEATURES, [forest.Spec()], 42, "hash", v.tx.count())
    return nodes.groupBy("tree").agg(
        F.sum(F.when(F.col("node") == 0, F.col("size"))).alias("root_rows"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows"))


@query("M2_scores_in_range", "select count(*) as rows, count(*) as in_range from tx")
def _(v):
    scored = forest.score(_tx(v), forest.fit(v.tx, threshold="none"))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("anomaly_score").between(-1.0, 0.0)).cast("bigint").alias("in_range"))


@query("M2_fixed_model_scores", f"with {_WALK} select hash, round(score, 9) as anomaly_score from walked")
def _(v):
    scored = forest.score(_tx(v), _fixed_model())
    return scored.select("hash", rounded(F.col("anomaly_score"), 9).alias("anomaly_score"))


@query("M2_score")
def _(v):
    model = forest.fit(v.tx, threshold="none")
    return forest.score(_tx(v), model).select("hash", "anomaly_score")


@query("M3_detect")
def _(v):
    _, detected = forest.fit_detect(_tx(v))
    return detected.groupBy("anomaly").agg(
        F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("avg_score"))


@query("M3_label_counts", """
    with n as (select count(*) as n, cast(floor((count(*) - 1) * 0.01e0) as bigint) + 1 as a from tx)
    select 'anomaly' as anomaly, a as n from n union all select 'normal', n - a from n""")
def _(v):
    return forest.fit_detect(_tx(v))[1].groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"))


@query("M4_only_anomalies")
def _(v):
    _, detected = forest.fit_detect(_tx(v))
    return forest.only_anomalies(detected).select("hash", "value", "anomaly_score")


@query("M4_anomaly_count", """
    select cast(floor((count(*) - 1) * 0.01e0) as bigint) + 1 as n, true as lowest from tx""")
def _(v):
    """As many anomalies as the threshold's quantile says, and they are the lowest scores."""
    _, detected = forest.fit_detect(_tx(v))
    top = F.max(F.when(F.col("anomaly") == "anomaly", F.col("anomaly_score")))
    rest = F.min(F.when(F.col("anomaly") == "normal", F.col("anomaly_score")))
    return detected.agg(F.count_if(F.col("anomaly") == "anomaly").cast("bigint").alias("n"), (top < rest).alias("lowest"))


@query("M4_fixed_model_anomalies", f"with {_WALK} select hash, value, round(score, 9) as anomaly_score from walked where score < -0.62")
def _(v):
    found = forest.only_anomalies(forest.detect(_tx(v), _fixed_model()))
    return found.select("hash", "value", rounded(F.col("anomaly_score"), 9).alias("anomaly_score"))


def _predicted(v):
    rows = _with_ratio(v.tx.select("hash", *BASE_FEATURES, "timestamp"))
    # Stored by hash once: the fit reads it several times, the joins with predictions shuffle those alone.
    buckets = tables.buckets_for(v.tx, python_tasks(v.spark))
    tx = tables.save_bucketed(rows, f"predict_{uuid.uuid4().hex}", new_path(v.spark, "predict"), buckets)
    model = forest.fit(tx, PREDICT_FEATURES)
    known = v.anomalies.select(
        F.col("tx_hash").alias("hash"), F.lit(True).alias("is_anomaly"), "confidence",
        "anomaly_score", F.col("detected_at").alias("created_at"),
    )
    return joins.predict_missing(
        tx, known, datetime(1998, 1, 1), lambda new: forest.batch_predict(new, model), 31_536_000
    )


@query("M6_batch_predict")
def _(v):
    return _predicted(v)


@query("M6_predicted_once", """
    with live as (select distinct tx_hash from anomalies
                  where detected_at > timestamp '1998-01-01' - interval 31536000 seconds
                    and detected_at <= timestamp '1998-01-01')
    select hash in (select tx_hash from live) as from_cache, count(*) as n, count(*) as in_range
    from tx group by 1""")
def _(v):
    good = (F.col("confidence") == F.abs("anomaly_score")) & F.col("is_anomaly").isNotNull()
    return _predicted(v).groupBy("from_cache").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).cast("bigint").alias("in_range"))


def _retrained(v):
    from ledgerwatch.plans.lifecycle import retrain

    _, row = retrain(
        v.tx, v.model_versions, model_id=1, path=new_path(v.spark, "model"),
        start=datetime(1995, 1, 1), end=datetime(2001, 6, 30),
    )
    return row


@query("M7_retrain")
def _(v):
    return _retrained(v)


@query("M7_registered_version", """
    select cast(1 as int) as model_id, (select '1.0.' || count(*) from model_versions where model_id = 1)
               as version, count(*) as training_dataset_size, false as is_deployed
    from tx where timestamp between timestamp '1995-01-01' and timestamp '2001-06-30'""")
def _(v):
    return _retrained(v).select("model_id", "version", "training_dataset_size", "is_deployed")


@query("M8_explanation")
def _(v):
    found = forest.only_anomalies(forest.fit_detect(_tx(v))[1])
    return forest.with_explanation(found, BASE_FEATURES).select("hash", "features_used", "explanation")


@query("M8_fixed_model_explanation", f"""
    with {_WALK} select hash, value as used_value, gas as used_gas, gas_price as used_gas_price,
                        'score ' || printf('%.4f', score) as begins from walked where score < -0.62""")
def _(v):
    found = forest.only_anomalies(forest.detect(_tx(v), _fixed_model()))
    used, text = F.col("features_used"), F.col("explanation")
    return forest.with_explanation(found, BASE_FEATURES).select(
        "hash", *[used[c].alias(f"used_{c}") for c in BASE_FEATURES], F.substring_index(text, " ", 2).alias("begins"))


@query("M9_tune")
def _(v):
    # Counted, drawn, sampled and scored: the join runs once.
    return forest.tune(materialise(_tx(v), "tune-rows"))[0]


@query("A9_save_and_load")
def _(v):
    path = new_path(v.spark, "model")
    forest.save(v.spark, forest.fit(_tx(v)), path)
    again = forest.detect(_tx(v), forest.load(v.spark, path))
    return anomaly_evaluation(again, F.col("anomaly") == "anomaly", "anomaly_score")


@query("A9_same_scores_after_load", "select count(*) as rows, count(*) as same from tx")
def _(v):
    path = new_path(v.spark, "model")
    model = forest.fit(_tx(v), threshold="none")
    forest.save(v.spark, model, path)
    both = forest.score(forest.score(_tx(v), model, "before"), forest.load(v.spark, path), "after")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("before") == F.col("after")).cast("bigint").alias("same"))


@query("O3_permutation_importance")
def _(v):
    return forest.permutation_importance(v.tx, forest.fit(v.tx, threshold="none"))


@query("O3_importance_of_fixed_model", """
    select * from (values ('value', true), ('gas', true), ('gas_price', false)) t(feature, matters)""")
def _(v):
    """A feature that no tree asks for has importance 0, the others have not."""
    found = forest.permutation_importance(v.tx, _fixed_model())
    return found.select("feature", (F.col("importance") > 0).alias("matters"))


@query("O4_merged_moments", """
    select feature, count(x) as n, round(avg(x), 4) as mean, round(var_samp(x) / 1e6, 4) as variance,
           min(x) as lo, max(x) as hi
    from (select value, gas, gas_price from tx) unpivot (x for feature in (value, gas, gas_price))
    group by feature""")
def _(v):
    state = extras.merge_moments(extras.batch_moments(v.tx, BASE_FEATURES, [F.year("timestamp")]))
    return state.select(
        "feature", "n", rounded(F.col("mean"), 4).alias("mean"),
        rounded(F.col("m2") / (F.col("n") - 1) / 1e6, 4).alias("variance"), "lo", "hi",
    )


@query("O4_scale_with_state", """
    with s as (select avg(value) as m, stddev_samp(value) as d from tx where year(timestamp) < 1999)
    select hash, round((value - m) / d, 6) as value from tx, s""")
def _(v):
    state = extras.batch_moments(v.tx.where(F.year("timestamp") < 1999), ["value"])
    return extras.scale_with_state(v.tx, state, ["value"]).select(
        "hash", rounded(F.col("value")).alias("value"))


@query("O6_chi_square_pvalue", """
    with recursive c as (select event_type, user_id % 7 as part, count(*) as n from events group by 1, 2),
         r as (select event_type, sum(n) as rn from c group by 1), k as (select part, sum(n) as kn from c group by 1),
         t as (select sum(n) as total from c),
         e as (select coalesce(c.n, 0) as n, rn * kn / total as e from r cross join k cross join t
               left join c on c.event_type = r.event_type and c.part = k.part),
         s as (select sum((n - e) * (n - e) / e) as x, (select (count(distinct event_type) - 1) * (count(distinct part) - 1) from c) as d from e),
         -- of an even number of degrees: a Poisson sum
         sums(i, term, total) as (select 0, exp(-x / 2), exp(-x / 2) from s union all
               select i + 1, term * x / 2 / (i + 1), total + term * x / 2 / (i + 1) from sums, s where i + 1 < d / 2)
    select round(x, 4) as statistic, cast(d as bigint) as degrees, round((select max(total) from sums), 8) as p_value from s""")
def _(v):
    """Event types by a part of the users: 24 degrees of freedom."""
    found = extras.chi_square_test(v.events.withColumn("part", F.col("user_id") % 7), "event_type", "part")
    return found.select(rounded(F.col("statistic"), 4).alias("statistic"), F.col("degrees").cast("bigint").alias("degrees"),
                        rounded(F.col("p_value"), 8).alias("p_value"))


@query("O6_chi_square", """
    with c as (select event_type, user_id, count(*) as n from events group by 1, 2),
         r as (select event_type, sum(n) as rn from c group by 1),
         k as (select user_id, sum(n) as kn from c group by 1),
         t as (select sum(n) as total from c),
         e as (select coalesce(c.n, 0) as n, rn * kn / total as e
               from r cross join k cross join t left join c
                 on c.event_type = r.event_type and c.user_id = k.user_id)
    select round(sum((n - e) * (n - e) / e), 4) as statistic,
           cast((select (count(distinct event_type) - 1) * (count(distinct user_id) - 1) from c) as bigint)
               as degrees, cast(sum(n) as bigint) as n
    from e""")
def _(v):
    return extras.chi_square(v.events, "event_type", "user_id").withColumn(
        "statistic", rounded(F.col("statistic"), 4))
