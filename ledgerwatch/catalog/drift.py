"""Queries: evaluation and drift."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import query
from ledgerwatch.functions.numeric import rounded
from ledgerwatch.operators import drift, evaluate, prefix
from ledgerwatch.session import materialise

PERIODS = drift.Periods(datetime(1998, 1, 1))


@query("E1_anomaly_evaluation", """
    select count(*) as num_samples, count(*) filter (where y_pred = 1) as num_anomalies_detected,
           count(*) filter (where y_pred <> 1) as num_normal_detected,
           round(avg(case when y_pred = 1 then 1.0e0 else 0 end), 6) as anomaly_rate,
           round(avg(score), 6) as mean_anomaly_score, round(stddev_pop(score), 6) as std_anomaly_score,
           min(score) as min_anomaly_score, max(score) as max_anomaly_score,
           round(max(score) - min(score), 6) as score_range
    from scored""")
def _(v):
    result = evaluate.anomaly_evaluation(v.scored, F.col("y_pred") == 1)
    return result.withColumns({c: rounded(F.col(c)) for c in (
        "anomaly_rate", "mean_anomaly_score", "std_anomaly_score", "score_range")})


@query("E2_binary_evaluation", """
    with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp,
                      count(*) filter (where quality <> 1 and toxic = 1) as fp,
                      count(*) filter (where quality <> 1 and toxic <> 1) as tn,
                      count(*) filter (where quality = 1 and toxic <> 1) as fn from labels)
    select tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives,
           round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
           round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
           round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1_score
    from c""")
def _(v):
    result = evaluate.binary_evaluation(v.labels, F.col("quality") == 1, F.col("toxic") == 1)
    return result.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1_score")})


_CLASSES = """
    with p as (select event_type as y_true, case when value > 150 then 'error' when value > 100 then 'click'
                      when value > 50 then 'view' else 'purchase' end as y_pred from events)"""


def _classes(v):
    guess = F.when(F.col("value") > 150, "error").when(F.col("value") > 100, "click").when(
        F.col("value") > 50, "view").otherwise("purchase")
    return v.events.select(F.col("event_type").alias("y_true"), guess.alias("y_pred"))


@query("E3_confusion_matrix", f"{_CLASSES} select y_true, y_pred, count(*) as n from p group by 1, 2")
def _(v):
    return evaluate.confusion_matrix(_classes(v))


@query("E3_class_evaluation", f"""
    {_CLASSES}, t as (select y_true as label, count(*) as support,
                             count(*) filter (where y_true = y_pred) as hits from p group by 1),
    g as (select y_pred as label, count(*) as predicted from p group by 1),
    c as (select support, hits, coalesce(predicted, 0) as predicted from t left join g using (label))
    select round(sum(support * case when predicted = 0 then 0 else hits / predicted end) / sum(support), 6)
               as precision,
           round(sum(support * (hits / support)) / sum(support), 6) as recall,
           round(sum(support * (2 * hits / (support + predicted))) / sum(support), 6) as f1_score,
           cast(sum(support) as bigint) as n
    from c""")
def _(v):
    result = evaluate.class_evaluation(_classes(v))
    return result.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1_score")})


@query("E4_roc_auc", """
    with s as (select score, count(*) filter (where y_true = 1) as pos,
                      count(*) filter (where y_true = 0) as neg from scored group by 1),
         c as (select pos, neg, sum(neg) over (order by score) - neg + neg / 2 as below from s)
    select round(sum(pos * below) / (sum(pos) * sum(neg)), 6) as roc_auc from c""")
def _(v):
    return evaluate.roc_auc(v.scored).withColumn("roc_auc", rounded(F.col("roc_auc")))


@query("E5_compare_evaluations", """
    with m as (select status, metric, value from (
            select case when y_true = 1 then 'a' else 'b' end as status, count(*)::double as num_samples,
                   avg(score) as mean_anomaly_score, max(score) - min(score) as score_range
            from scored group by 1) unpivot (value for metric in (num_samples, mean_anomaly_score, score_range)))
    select a.metric, round(a.value, 6) as model1, round(b.value, 6) as model2,
           round(b.value - a.value, 6) as difference, round((b.value - a.value) * 100 / a.value, 6) as percent_change
    from m a join m b on a.metric = b.metric where a.status = 'a' and b.status = 'b'""")
def _(v):
    from ledgerwatch.operators.joins import compare_metrics

    def side(label):
        return evaluate.anomaly_evaluation(v.scored.where(F.col("y_true") == label), F.col("y_pred") == 1)

    both = compare_metrics(side(1), side(0), ["num_samples", "mean_anomaly_score", "score_range"])
    return both.select("metric", *[
        rounded(F.col(c)).alias(c) for c in ("model1", "model2", "difference", "percent_change")])


_TAGGED = """
    tagged as (select *, case when timestamp between timestamp '1997-11-25' and timestamp '1997-12-25'
                              then 1 else 0 end as ref,
                      case when timestamp between timestamp '1997-12-25' and timestamp '1998-01-01'
                              then 1 else 0 end as det
               from tx where timestamp between timestamp '1997-11-25' and timestamp '1998-01-01'),
    counts as (select cast(sum(ref) as bigint) as reference_count,
                      cast(sum(det) as bigint) as detection_count from tagged),
    long as (select ref, det, feature, x from (select ref, det, value, gas, gas_price from tagged)
             unpivot (x for feature in (value, gas, gas_price)))"""
_KS = """
    per_value as (select feature, x, sum(ref) as ref, sum(det) as det from long group by 1, 2),
    cdf as (select feature, sum(ref) over w / sum(ref) over t as r, sum(det) over w / sum(det) over t as d,
                   sum(ref) over t as n, sum(det) over t as m
            from per_value window w as (partition by feature order by x), t as (partition by feature)),
    ks as (select feature, max(abs(r - d)) as ks_statistic, cast(max(n) as bigint) as n_reference,
                  cast(max(m) as bigint) as n_detection from cdf group by 1),
    scaled as (select *, sqrt(n_reference * n_detection / (n_reference + n_detection)) * ks_statistic as z
               from ks),
    pv as (select *, case when z < 0.2 then 1.0e0 else least(greatest(2 * list_sum(list_transform(
                  range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end)
                  * exp(-2.0e0 * k * k * z * z))), 0), 1) end as ks_pvalue from scaled)"""
_PSI = """
    bounds as (select feature, min(x) filter (where ref = 1) as lo, max(x) filter (where ref = 1) as hi,
                      sum(ref) as rt, sum(det) as dt from long group by 1),
    bins as (select l.feature, cast(list_sum(list_transform(range(1, 10),
                    lambda i: case when x >= lo + i * ((hi - lo) / 10) then 1 else 0 end)) as int) as bin,
                    sum(ref) as ref, sum(det) as det
             from long l join bounds b on l.feature = b.feature where x between lo and hi group by 1, 2),
    shares as (select s.feature, coalesce(ref, 0) / rt + 1e-10 as r, coalesce(det, 0) / dt + 1e-10 as d
               from (select feature, rt, dt, unnest(range(10)) as bin from bounds) s
               left join bins b on s.feature = b.feature and s.bin = b.bin),
    psi as (select feature, abs(sum((d - r) * ln(d / r))) as psi from shares group by 1)"""
_FEATURES = """
    means as (select feature, avg(x) filter (where ref = 1) as rm, avg(x) filter (where det = 1) as dm
              from long group by 1),
    fd as (select pv.feature, round(ks_statistic, 4) as ks_statistic, round(ks_pvalue, 4) as ks_pvalue,
                  round(psi, 4) as psi, round(rm, 4) as reference_mean, round(dm, 4) as detection_mean,
                  round(abs(dm - rm) / (rm + 1e-10) * 100, 2) as mean_change_pct,
                  ks_pvalue < 0.05 or psi > 0.2 or abs(dm - rm) / (rm + 1e-10) > 0.1 as drift_detected
           from pv join psi on pv.feature = psi.feature join means on pv.feature = means.feature)"""
_SEVERITY = """
    ds as (select count(*) as features, count(*) filter (where drift_detected) as drifted_features,
                  max(psi) as max_psi,
                  case when count(*) filter (where drift_detected) = 0 then 'none'
                       when count(*) filter (where drift_detected) / count(*) >= 0.75 or max(psi) > 0.5
                           then 'critical'
                       when count(*) filter (where drift_detected) / count(*) >= 0.5 or max(psi) > 0.3
                           then 'high'
                       when count(*) filter (where drift_detected) / count(*) >= 0.25 or max(psi) > 0.2
                           then 'moderate' else 'low' end as drift_severity
           from fd)"""


def _tagged(v):
    return drift.tagged(v.tx, PERIODS)


@query("K1_windows", f"""
    with {_TAGGED} select *, reference_count > 0 and detection_count > 0 as sufficient from counts""")
def _(v):
    return drift.window_counts(_tagged(v))


@query("K2_ks_statistic", f"""
    with {_TAGGED}, {_KS}
    select feature, round(ks_statistic, 6) as ks_statistic, n_reference, n_detection from ks""")
def _(v):
    return drift.ks_statistic(drift.by_feature(_tagged(v))).withColumn(
        "ks_statistic", rounded(F.col("ks_statistic")))


@query("K3_ks_pvalue", f"with {_TAGGED}, {_KS} select feature, round(ks_pvalue, 6) as ks_pvalue from pv")
def _(v):
    ks = drift.ks_statistic(drift.by_feature(_tagged(v)))
    return ks.select("feature", rounded(drift.ks_pvalue(
        F.col("ks_statistic"), F.col("n_reference"), F.col("n_detection"))).alias("ks_pvalue"))


_HALVES = "timestamp '1995-06-01'"


@query("K3_exact_pvalue", f"""
    with recursive long as (select from_address as feature, value as x, case when timestamp < {_HALVES} then 1 else 0 end as ref,
                                   case when timestamp < {_HALVES} then 0 else 1 end as det from tx),
    per_value as (select feature, x, sum(ref) as ref, sum(det) as det from long group by 1, 2),
    cdf as (select feature, sum(ref) over w as r, sum(det) over w as d, sum(ref) over t as m, sum(det) over t as n from per_value
            window w as (partition by feature order by x), t as (partition by feature)),
    ks as (select feature, cast(max(m) as bigint) as m, cast(max(n) as bigint) as n, cast(max(abs(r * n - d * m)) as bigint) as h
           from cdf where m > 0 and n > 0 group by 1),
    dp(feature, m, n, h, k, b) as (
      select feature, m, n, h, cast(0 as bigint), [case when h <= 0 then 1e0 else 0e0 end] from ks
      union all
      select feature, m, n, h, k + 1, list_transform(range(0, least(m, k + 1) + 1), lambda i: case
          when k + 1 - i > n then 0e0 when abs(i * n - (k + 1 - i) * m) >= h then 1e0
          else (coalesce(b[i], 0e0) * i + coalesce(b[i + 1], 0e0) * (k + 1 - i)) / (k + 1) end)
      from dp where k < m + n)
    select feature, m as n_reference, n as n_detection, round(h / (m * n), 6) as ks_statistic, round(b[m + 1], 8) as ks_pvalue
    from dp where k = m + n""")
def _(v):
    """Did an address's values change at a date? Few rows each, so the exact law counts."""
    early = (F.col("timestamp") < F.lit("1995-06-01").cast("timestamp")).cast("bigint")
    long = v.tx.select(F.col("from_address").alias("feature"), F.col("value").alias("x"), early.alias("ref"), (1 - early).alias("det"))
    ks = drift.ks_pvalue_exact(drift.ks_statistic(long))
    return ks.withColumns({"ks_statistic": rounded(F.col("ks_statistic")), "ks_pvalue": rounded(F.col("ks_pvalue"), 8)})


@query("W3_quantile_of_a_column", """
    select round(quantile_cont(value, 0.37), 6) as q37, round(quantile_cont(value, 0.995), 6) as q995 from tx""")
def _(v):
    """One column of the whole table, by passes that cut at its own values."""
    column = materialise(v.tx.select("value"), "column")  # the passes would join the tables each time
    found = [round(prefix.exact_quantile(column, "value", s), 6) for s in (0.37, 0.995)]
    return v.spark.createDataFrame([tuple(found)], "q37 double, q995 double")


@query("K4_psi", f"with {_TAGGED}, {_PSI} select feature, round(psi, 6) as psi from psi")
def _(v):
    return drift.psi(drift.by_feature(_tagged(v))).withColumn("psi", rounded(F.col("psi")))


@query("K5_feature_drift", f"with {_TAGGED}, {_KS}, {_PSI}, {_FEATURES} select * from fd")
def _(v):
    return drift.feature_drift(_tagged(v))


@query("K6_drift_severity", f"with {_TAGGED}, {_KS}, {_PSI}, {_FEATURES}, {_SEVERITY} select * from ds")
def _(v):
    return drift.drift_severity(drift.feature_drift(_tagged(v)))


def _window_flags(extra: str = "") -> str:
    return f"""
    flagged as (select *, detected_at between timestamp '1997-11-25' and timestamp '1997-12-25' as ref,
                       detected_at between timestamp '1997-12-25' and timestamp '1998-01-01' as det
                from anomalies
                where detected_at between timestamp '1997-11-25' and timestamp '1998-01-01' {extra})"""


_SEVERITY_COUNTS = ", ".join(
    f"count(*) filter (where {w} and severity = '{s}') as {name}_{s}"
    for w, name in (("ref", "reference"), ("det", "detection"))
    for s in ("low", "medium", "high", "critical")
)
_CONCEPT = f"""
    {_window_flags()},
    wide as (select model_version_id, count(*) filter (where ref) as rn, count(*) filter (where det) as dn,
                    coalesce(avg(confidence) filter (where ref), 0) as rc,
                    coalesce(avg(confidence) filter (where det), 0) as dc, {_SEVERITY_COUNTS}
             from flagged group by 1),
    concept as (select *, rn > 0 and (abs(dn / 7 - rn / 30) / (rn / 30 + 1e-10) > 0.1 or abs(dc - rc) > 0.1)
                    as drift_detected from wide)"""


@query("K7_concept_drift", f"""
    with {_CONCEPT}
    select model_version_id, drift_detected,
           case when rn > 0 then round(abs(dn / 7 - rn / 30) / (rn / 30 + 1e-10) * 100, 2) end
               as anomaly_rate_change_pct,
           case when rn > 0 then round(rn / 30, 4) end as reference_anomaly_rate,
           case when rn > 0 then round(dn / 7, 4) end as detection_anomaly_rate,
           case when rn > 0 then round(abs(dc - rc), 4) end as confidence_change,
           case when rn > 0 then round(rc, 4) end as reference_confidence,
           case when rn > 0 then round(dc, 4) end as detection_confidence,
           {', '.join(f'{n}_{s}' for n in ('reference', 'detection')
                      for s in ('low', 'medium', 'high', 'critical'))}
    from concept""")
def _(v):
    return drift.concept_drift(v.anomalies, PERIODS)


_PERFORMANCE = f"""
    reviewed as (select * from ({_window_flags('and reviewed').strip()[len('flagged as ('):]}),
    perf as (select model_version_id, count(*) filter (where ref) as rn, count(*) filter (where det) as dn,
                    coalesce(avg(case when not coalesce(false_positive, false) then 1.0e0 else 0 end)
                             filter (where ref), 0) as rp,
                    coalesce(avg(case when not coalesce(false_positive, false) then 1.0e0 else 0 end)
                             filter (where det), 0) as dp
             from reviewed group by 1)"""


@query("K8_performance_drift", f"""
    with {_PERFORMANCE}
    select model_version_id, rn > 0 and abs(dp - rp) > 0.1 as drift_detected,
           case when rn > 0 then round(rp, 4) end as reference_precision,
           case when rn > 0 then round(dp, 4) end as detection_precision,
           case when rn > 0 then round(abs(dp - rp), 4) end as precision_change,
           rn as reference_reviewed_count, dn as detection_reviewed_count
    from perf""")
def _(v):
    return drift.performance_drift(v.anomalies, PERIODS)


_LADDER = """
    case when p then 'performance' when s = 'critical' then 'feature_critical'
         when f and c then 'feature_and_concept' when s = 'high' then 'feature_high'
         when c then 'concept' when s = 'moderate' then 'feature_moderate'
         when f then 'feature_low' else 'none' end"""


_ADVICE = "case " + _LADDER + " " + " ".join(
    f"when '{code}' then '{level.upper()}: {words}'" for code, level, words in drift.RECOMMENDATIONS) + " end"


@query("K9_recommendation", f"""
    with flags as (select id, value > 250 as p, event_type = 'click' as c, event_type <> 'view' as f,
                          case when value > 150 then 'critical' when value > 100 then 'high'
                               when value > 50 then 'moderate' else 'low' end as s
                   from (select event_id as id, value, event_type from events))
    select id, {_LADDER} as code from flags""")
def _(v):
    e = v.events.withColumn("s", F.when(F.col("value") > 150, "critical").when(
        F.col("value") > 100, "high").when(F.col("value") > 50, "moderate").otherwise("low"))
    return e.select(F.col("event_id").alias("id"), drift.recommendation(
        F.col("event_type") != "view", F.col("event_type") == "click", F.col("value") > 250, F.col("s"),
    ).alias("code"))


@query("K10_drift_report", f"""
    with {_TAGGED}, {_KS}, {_PSI}, {_FEATURES}, {_SEVERITY}, {_CONCEPT}, {_PERFORMANCE},
    ids as (select distinct model_version_id from anomalies),
    j as (select ids.model_version_id, counts.*, drifted_features > 0 as f, drift_severity as s,
                 coalesce(concept.drift_detected, false) as c,
                 coalesce(perf.rn > 0 and abs(dp - rp) > 0.1, false) as p,
                 case when concept.rn > 0 then
                     round(abs(concept.dn / 7 - concept.rn / 30) / (concept.rn / 30 + 1e-10) * 100, 2) end
                     as anomaly_rate_change_pct,
                 case when concept.rn > 0 then round(abs(dc - rc), 4) end as confidence_change,
                 case when perf.rn > 0 then round(abs(dp - rp), 4) end as precision_change
          from ids cross join counts cross join ds
          left join concept on ids.model_version_id = concept.model_version_id
          left join perf on ids.model_version_id = perf.model_version_id)
    select model_version_id, reference_count, detection_count, false as insufficient_data,
           f as feature_drift, c as concept_drift, p as performance_drift, s as drift_severity,
           anomaly_rate_change_pct, confidence_change, precision_change, f or c or p as drift_detected,
           {_LADDER} as recommendation, {_ADVICE} as advice
    from j""")
def _(v):
    return drift.drift_report(v.tx, v.anomalies, PERIODS)


@query("W3_exact_quantiles", """
    select severity, round(quantile_cont(confidence::double, 0.37), 6) as quantile
    from anomalies group by severity""")
def _(v):
    return prefix.exact_quantiles(v.anomalies, ["severity"], "confidence", 0.37).withColumn(
        "quantile", rounded(F.col("quantile")))


@query("W3_running_share", """
    with s as (select score, count(*) as n from scored group by 1)
    select score, cast(sum(n) over (order by score) as bigint) as n_upto,
           round(sum(n) over (order by score) / sum(n) over (), 6) as share from s""")
def _(v):
    ones = v.scored.select("score", F.lit(1).cast("bigint").alias("n"))
    sums = prefix.running_sums(ones, [], "score", ["n"])
    return sums.select("score", "n_upto", rounded(F.col("n_upto") / F.col("n_total")).alias("share"))
