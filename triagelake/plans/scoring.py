"""Queries over features, scorers, thresholds, the gate and the evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions.scale import materialize
from triagelake.operators import calibration as cal
from triagelake.operators import evaluation as ev
from triagelake.operators import scorers, windows
from triagelake.plans import base
from triagelake.plans.base import ALPHA, B0, WINDOWS, rounded, sql
from triagelake.sources import tables

CAL = "calibration"


def _part(w, split=CAL):
    return w.filter(F.col("split") == split)


def triage_minimum_slice(spark, sf):
    """Windows, split, frequency score, conformal threshold, gate and metrics per split."""
    s = base.scored_stage(spark, sf)
    t = cal.threshold_map(_part(s), [ALPHA])
    return rounded(cal.alpha_sweep(s, t, by=["split"]))


def count_vectors(spark, sf, mode="normalized_count"):
    w = base.event_windows(spark, sf)
    counts = windows.sequence_counts(w)
    vocab = scorers.vocabulary(windows.sequence_counts(_part(w, "train")))
    return rounded(scorers.count_vectors(counts, vocab, mode).drop("dataset"))


def count_vectors_log(spark, sf):
    return count_vectors(spark, sf, "log1p_count")


def sequence_tokens(spark, sf):
    w = base.event_windows(spark, sf)
    vocab = scorers.vocabulary(windows.sequence_counts(_part(w, "train")), 2)
    p = scorers.pad_sequences(scorers.encode_sequences(w, vocab, 100), 8)
    return p.select("window_id", F.array_join("input_ids", " ").alias("input_ids"), F.col("length").cast("long").alias("length"), F.array_join(F.transform("attention_mask", lambda m: m.cast("int")), " ").alias("mask"))


def b0_scores(spark, sf):
    return rounded(base.b0_scored(base.event_windows(spark, sf)).select("window_id", "score"))


def b0_session_scores(spark, sf):
    """The frequency scorer over sessions, from long counts."""
    r = tables.event_day_sessions(spark, sf).withColumn("window_id", F.col("session_id"))
    counts = windows.template_counts(r)
    return rounded(scorers.frequency_scores(counts, scorers.fit_frequency(counts)).select("window_id", "score"))


def next_template_nll(spark, sf):
    return rounded(base.b2_scored(base.event_windows(spark, sf)).select("window_id", "b2_score"))


def _features(spark, sf):
    w = base.event_windows(spark, sf)
    vocab = scorers.vocabulary(windows.sequence_counts(_part(w, "train")))
    f = materialize(scorers.count_vectors(windows.sequence_counts(w), vocab), "features")
    return w, f, f.join(_part(w, "train").select("window_id"), "window_id"), vocab.count() + 1


def _pca(spark, sf):
    w, f, train, d = _features(spark, sf)
    return w, scorers.pca_scores(f, d, scorers.fit_pca(train, d))


def pca_error(spark, sf):
    return rounded(_pca(spark, sf)[1].select("window_id", "score"))


def isolation_forest(spark, sf):
    _, f, train, d = _features(spark, sf)
    return rounded(scorers.isolation_scores(f, d, scorers.fit_isolation_forest(train, d)).select("window_id", "score"))


def score_and_classify(spark, sf):
    s = base.scored_stage(spark, sf)
    t = cal.quantile_threshold(_part(s), 0.95).first()["threshold"]
    return rounded(scorers.classify(s, t).select("window_id", "split", "pred"))


def train_score_distribution(spark, sf):
    s = base.scored_stage(spark, sf)
    return rounded(cal.score_stats(_part(s, "train")))


def quantile_threshold(spark, sf):
    s = base.scored_stage(spark, sf)
    return rounded(cal.quantile_threshold(s, 0.95, by=["split"]))


def oracle_threshold(spark, sf):
    return rounded(cal.oracle_threshold(_part(base.scored_stage(spark, sf))))


def score_stats(spark, sf):
    return rounded(cal.score_distribution(_part(base.scored_stage(spark, sf))))


def calibration_diagnostics(spark, sf):
    c = materialize(_part(base.scored_stage(spark, sf)), "calibration")
    t = cal.quantile_threshold(c, 0.95).first()["threshold"]
    m = cal.selective_performance(cal.confusion(c, F.col("score") > t, F.col("y")))
    m = m.select(
        F.lit(t).alias("threshold"), "tp", "fp", "tn", "fn", "total_windows", "total_anomalies", "n_escalated",
        F.col("escalation_precision").alias("precision"), F.col("escalation_recall").alias("recall"), F.col("escalation_f1").alias("f1"),
        F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).otherwise(F.lit(0.0)).alias("specificity"),
    )
    r = ev.ranking_metrics(c).select(F.struct("roc_auc", F.col("average_precision").alias("pr_auc"))).scalar()
    return rounded(m.withColumn("_r", r).select(*m.columns, "_r.*"))


def error_topk(spark, sf):
    c = materialize(_part(base.scored_stage(spark, sf)), "calibration")
    t = cal.quantile_threshold(c, 0.95).first()["threshold"]
    e = cal.error_analysis(c, t)
    return rounded(e.withColumn("unique_templates", F.array_join("unique_templates", " ")))


def conformal_threshold(spark, sf):
    return rounded(cal.conformal_thresholds(_part(base.scored_stage(spark, sf))))


def conformal_pvalues(spark, sf):
    s = base.scored_stage(spark, sf)
    return rounded(cal.conformal_p_values(_part(s), s).select("window_id", "split", "p_value"))


def calibrator_metadata(spark, sf):
    return rounded(cal.calibrator_metadata(_part(base.scored_stage(spark, sf))))


def gate_decisions(spark, sf):
    s = base.scored_stage(spark, sf)
    return cal.gate(s, cal.threshold_map(_part(s), [ALPHA])[ALPHA]).select("window_id", "split", "decision")


def alpha_sweep(spark, sf):
    c = materialize(_part(base.scored_stage(spark, sf)), "calibration")
    return rounded(cal.alpha_sweep(c, cal.threshold_map(c)))


def ablation_fixed_quantile(spark, sf):
    c = materialize(_part(base.scored_stage(spark, sf)), "calibration")
    t = cal.quantile_threshold(c, 0.95).first()["threshold"]
    return rounded(cal.selective_performance(cal.confusion_at(c, {"fixed_quantile": t}, key="method")))


def ablation_models_one_gate(spark, sf):
    """Two score columns, each under its own conformal threshold."""
    c = materialize(_part(base.scored_stage(spark, sf, b2=True)), "calibration")
    out = None
    for model, col in (("B0", "score"), ("B2", "b2_score")):
        row = cal.alpha_sweep(c, cal.threshold_map(c, score=col), score=col).withColumn("model", F.lit(model))
        out = row if out is None else out.unionByName(row)
    return rounded(out.select("model", "alpha", "threshold", "tp", "fp", "tn", "fn", "escalation_rate", "coverage", "selective_risk"))


def ablation_pca_gate(spark, sf):
    w, p = _pca(spark, sf)
    c = materialize(scorers.attach_scores(_part(w), p).withColumn("y", F.col("is_anomaly").cast("int")), "pca")
    return rounded(cal.alpha_sweep(c, cal.threshold_map(c)))


def ablation_calibration_size(spark, sf):
    c = materialize(_part(base.scored_stage(spark, sf)), "calibration")
    return rounded(cal.calibration_size_sensitivity(c))


def baseline_comparison(spark, sf):
    """One row per baseline: threshold, confusion counts, ranking metrics and best F1."""
    c = materialize(_part(base.scored_stage(spark, sf, b2=True)), "calibration")
    long = c.select("dataset", "window_id", "y", F.inline(F.array(
        F.struct(F.lit("B0").alias("system"), F.col("score").alias("s")), F.struct(F.lit("B2").alias("system"), F.col("b2_score").alias("s")))))
    th = {r["system"]: r["threshold"] for r in cal.quantile_threshold(long, 0.95, by=["system"], score="s").collect()}
    rank = ev.ranking_metrics(long, ["system"], score="s")
    out = None
    for system, t in th.items():
        one = long.filter(F.col("system") == system)
        m = cal.selective_performance(cal.confusion(one, F.col("s") > t, F.col("y")))
        best = cal.oracle_threshold(one, score="s").first()
        row = m.select(
            F.lit("events").alias("dataset"), F.lit(system).alias("system"), F.lit(t).alias("threshold"), F.col("n_escalated").alias("flagged_windows"),
            "total_anomalies", "tp", "fp", "fn", F.col("escalation_precision").alias("precision"), F.col("escalation_recall").alias("recall"),
            F.col("escalation_f1").alias("f1"), F.lit(best["f1"]).alias("oracle_best_f1"), F.lit(best["threshold"]).alias("oracle_best_threshold"),
        )
        out = row if out is None else out.unionByName(row)
    return rounded(out.join(rank.select("system", "roc_auc", F.col("average_precision").alias("pr_auc")), "system"))


QUERIES = {
    f.__name__: f
    for f in (
        triage_minimum_slice, count_vectors, count_vectors_log, sequence_tokens, b0_scores, b0_session_scores, next_template_nll, pca_error, isolation_forest,
        score_and_classify, train_score_distribution, quantile_threshold, oracle_threshold, score_stats, calibration_diagnostics, error_topk,
        conformal_threshold, conformal_pvalues, calibrator_metadata, gate_decisions, alpha_sweep, ablation_fixed_quantile, ablation_models_one_gate,
        ablation_pca_gate, ablation_calibration_size, baseline_comparison,
    )
}

_CAL = B0 + """,
cal AS (SELECT * FROM scored0 WHERE split = 'calibration'),
ord AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM cal),
alphas AS (SELECT CAST(unnest([0.01, 0.05, 0.10, 0.20]) AS DOUBLE) AS alpha),
tau AS (
  SELECT alpha, any_value(n) AS n_calibration, min(score) AS threshold FROM alphas, ord
  WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - alpha)))) GROUP BY alpha)"""

_Q95 = "(SELECT quantile_cont(score, 0.95::DOUBLE) FROM cal)"


def _perf(conf: str, extra: str = "", group: str = "", alpha: bool = True) -> str:
    """Selective-performance columns over a row source with tp, fp, tn, fn."""
    dev = ", round(fn / CAST(tp+fp+tn+fn AS DOUBLE) - alpha, 6) AS deviation_from_nominal" if alpha else ""
    return f"""
SELECT {extra} round(threshold, 6) AS threshold, tp, fp, tn, fn, tp+fp+tn+fn AS total_windows, tp+fn AS total_anomalies, tp+fp AS n_escalated, tn+fn AS n_cleared,
  round((tp+fp) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS escalation_rate, round((tn+fn) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS coverage,
  CASE WHEN tp+fp > 0 THEN round(tp / CAST(tp+fp AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS escalation_precision,
  CASE WHEN tp+fn > 0 THEN round(tp / CAST(tp+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS escalation_recall,
  CASE WHEN tp > 0 THEN round(2*tp / CAST(2*tp+fp+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS escalation_f1,
  CASE WHEN tn+fn > 0 THEN round(fn / CAST(tn+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS selective_risk,
  round(fn / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS empirical_false_clear_rate{dev}
FROM ({conf})"""


_COUNTS = "count(*) FILTER (WHERE score > threshold AND y = 1) AS tp, count(*) FILTER (WHERE score > threshold AND y = 0) AS fp, count(*) FILTER (WHERE score <= threshold AND y = 0) AS tn, count(*) FILTER (WHERE score <= threshold AND y = 1) AS fn"

_B2 = WINDOWS + """,
voc AS (SELECT template_id, row_number() OVER (ORDER BY template_id) + 1 AS token FROM (SELECT DISTINCT template_id FROM wrec JOIN win USING (window_id) WHERE split = 'train' AND template_id <> -1)),
nrm AS (SELECT window_id, row_number() OVER (ORDER BY start_time, first_line) - 1 AS p, count(*) OVER () AS n FROM win WHERE split = 'train' AND NOT is_anomaly),
fitw AS (SELECT window_id FROM nrm WHERE p < n - greatest(1, floor(n * 0.1::DOUBLE))),
tok AS (SELECT wrec.window_id, pos, coalesce(token, 1) AS token FROM wrec LEFT JOIN voc USING (template_id)),
stp AS (SELECT window_id, pos, token, lag(token) OVER (PARTITION BY window_id ORDER BY pos) AS prev, count(*) OVER (PARTITION BY window_id) AS len FROM tok),
uni AS (SELECT token, count(*) AS c FROM tok JOIN fitw USING (window_id) GROUP BY 1),
den AS (SELECT (SELECT sum(c) FROM uni) + 1.0::DOUBLE * ((SELECT count(*) FROM voc) + 1) AS d),
big AS (SELECT prev, token, count(*) AS c FROM stp JOIN fitw USING (window_id) WHERE prev IS NOT NULL GROUP BY 1, 2),
ctx AS (SELECT prev, sum(c) AS ctx FROM big GROUP BY 1),
b2 AS (
  SELECT window_id, round(avg(-ln((coalesce(big.c, 0) + 1.0::DOUBLE * coalesce((uni.c + 1.0::DOUBLE) / d, 1.0::DOUBLE / d)) / (coalesce(ctx, 0) + 1.0::DOUBLE))), 9) AS b2_score
  FROM stp CROSS JOIN den LEFT JOIN uni ON uni.token = stp.token LEFT JOIN big ON big.prev = stp.prev AND big.token = stp.token LEFT JOIN ctx ON ctx.prev = stp.prev
  WHERE stp.prev IS NOT NULL OR len = 1 GROUP BY 1)"""

B0_B2 = B0 + _B2[len(WINDOWS):]

_VEC = WINDOWS + """,
voc AS (SELECT template_id, row_number() OVER (ORDER BY template_id) - 1 AS idx FROM (SELECT DISTINCT template_id FROM wrec JOIN win USING (window_id) WHERE split = 'train' AND template_id <> -1)),
cells AS (SELECT window_id, coalesce(idx, (SELECT max(idx) + 1 FROM voc)) AS idx, count(*) AS n FROM wrec LEFT JOIN voc USING (template_id) GROUP BY ALL)"""

_STATS = """count(*) AS count, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
  round(quantile_cont(score, 0.25::DOUBLE), 6) AS p25, round(quantile_cont(score, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(score, 0.75::DOUBLE), 6) AS p75,
  round(quantile_cont(score, 0.9::DOUBLE), 6) AS p90, round(quantile_cont(score, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(score, 0.99::DOUBLE), 6) AS p99"""


def ranking_sql(source: str, score: str = "score") -> str:
    """CTEs giving roc_auc, pr_auc and average_precision of a (score, y) source as ``rk``."""
    return f""",
ps AS (SELECT {score} AS s, count(*) AS c, sum(y) AS p FROM {source} GROUP BY 1),
cum AS (SELECT s, c, p, sum(c) OVER (ORDER BY s DESC) AS nge, sum(p) OVER (ORDER BY s DESC) AS tp, sum(c) OVER () AS n, sum(p) OVER () AS pt FROM ps),
rk AS (
  SELECT sum(p * ((n - pt) - (nge - tp) + (c - p) / 2.0::DOUBLE) / (CAST(pt AS DOUBLE) * (n - pt))) AS roc_auc,
    sum(p / CAST(pt AS DOUBLE) * (tp / CAST(nge AS DOUBLE) + CASE WHEN nge > c THEN (tp - p) / CAST(nge - c AS DOUBLE) ELSE 1.0::DOUBLE END) / 2.0::DOUBLE) AS pr_auc,
    sum(p / CAST(pt AS DOUBLE) * tp / CAST(nge AS DOUBLE)) AS average_precision FROM cum)"""


def _oracle_sql(source: str, score: str = "score", name: str = "best") -> str:
    """CTEs for the best-F1 threshold of a source as one row ``name``."""
    return f""",
{name}_d AS (SELECT DISTINCT {score} AS t FROM {source}),
{name}_c AS (SELECT t FROM {name}_d),
{name}_m AS (SELECT t, count(*) FILTER (WHERE {score} > t AND y = 1) AS tp, count(*) FILTER (WHERE {score} > t AND y = 0) AS fp, count(*) FILTER (WHERE y = 1) AS pos FROM {name}_c, {source} GROUP BY t),
{name} AS (
  SELECT t AS threshold, CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + (pos - tp) AS DOUBLE) ELSE 0.0::DOUBLE END AS f1,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0::DOUBLE END AS precision, tp / CAST(pos AS DOUBLE) AS recall
  FROM {name}_m ORDER BY f1 DESC, t LIMIT 1)"""


def _size_rows() -> str:
    parts = []
    for f in ("0.25", "0.5", "1.0"):
        parts.append(f"""
SELECT {f}::DOUBLE AS fraction, CAST(greatest(5, floor((SELECT count(*) FROM cal) * {f}::DOUBLE)) AS BIGINT) AS m""")
    return " UNION ALL ".join(parts)


ORACLES = {
    "triage_minimum_slice": sql(_CAL, _perf(f"SELECT alpha, split, any_value(threshold) AS threshold, {_COUNTS} FROM scored0, tau WHERE alpha = 0.05::DOUBLE GROUP BY alpha, split", "split, alpha,")),
    "count_vectors": sql(_VEC, "SELECT window_id, idx, round(n / CAST(sum(n) OVER (PARTITION BY window_id) AS DOUBLE), 6) AS value FROM cells"),
    "count_vectors_log": sql(_VEC, "SELECT window_id, idx, round(ln(1 + n), 6) AS value FROM cells"),
    "sequence_tokens": sql(_B2, """
SELECT window_id, array_to_string(list(token ORDER BY pos) || list_value(0, 0, 0, 0, 0, 0, 0, 0)[1:8 - count(*)], ' ') AS input_ids, count(*) AS length,
  array_to_string([CASE WHEN i < count(*) THEN 1 ELSE 0 END FOR i IN range(8)], ' ') AS mask FROM tok GROUP BY 1"""),
    "b0_scores": sql(B0, "SELECT window_id, round(score, 6) AS score FROM scored0"),
    "b0_session_scores": sql(B0, """
, sr AS (SELECT session_id || ':' || strftime(make_timestamp(CAST(floor(ts_s * 1000000.0::DOUBLE) AS BIGINT)), '%Y-%m-%d') AS window_id, template_id FROM rec),
sf AS (SELECT template_id, count(*) AS n FROM sr GROUP BY 1),
sp AS (SELECT template_id, ln((n + 1.0::DOUBLE) / ((SELECT sum(n) FROM sf) + (SELECT count(*) FROM sf) + 1.0::DOUBLE)) AS lp FROM sf)
SELECT window_id, round(round(avg(-lp), 9), 6) AS score FROM sr JOIN sp USING (template_id) GROUP BY 1"""),
    "next_template_nll": sql(_B2, "SELECT window_id, round(b2_score, 6) AS b2_score FROM b2"),
    "score_and_classify": sql(_CAL, f"SELECT window_id, split, CAST(score > {_Q95} AS BIGINT) AS pred FROM scored0"),
    "train_score_distribution": sql(B0, f"SELECT {_STATS} FROM scored0 WHERE split = 'train'"),
    "quantile_threshold": sql(B0, "SELECT split, count(*) AS n, round(quantile_cont(score, 0.95::DOUBLE), 6) AS threshold FROM scored0 GROUP BY 1"),
    "oracle_threshold": sql(_CAL + _oracle_sql("cal"), "SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM best"),
    "score_stats": sql(_CAL, f"SELECT part, {_STATS} FROM (SELECT 'all' AS part, score FROM cal UNION ALL SELECT CASE WHEN y = 1 THEN 'anomalous' ELSE 'normal' END, score FROM cal) GROUP BY 1"),
    "calibration_diagnostics": sql(_CAL + ranking_sql("cal") + f", c AS (SELECT threshold, {_COUNTS} FROM cal, (SELECT {_Q95} AS threshold) GROUP BY threshold)", """
SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, tp+fp+tn+fn AS total_windows, tp+fn AS total_anomalies, tp+fp AS n_escalated,
  CASE WHEN tp+fp > 0 THEN round(tp / CAST(tp+fp AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp+fn > 0 THEN round(tp / CAST(tp+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN tp > 0 THEN round(2*tp / CAST(2*tp+fp+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS f1, round(tn / CAST(tn+fp AS DOUBLE), 6) AS specificity,
  round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS pr_auc FROM c, rk"""),
    "error_topk": sql(_CAL + f", b AS (SELECT *, score > {_Q95} AS predicted, y = 1 AS label FROM cal)", """
, u AS (
(SELECT 'highest' AS kind, * FROM b ORDER BY score DESC, window_id LIMIT 5) UNION ALL (SELECT 'false_positive', * FROM b WHERE predicted AND NOT label ORDER BY score DESC, window_id LIMIT 5)
UNION ALL (SELECT 'false_negative', * FROM b WHERE NOT predicted AND label ORDER BY score, window_id LIMIT 5))
SELECT kind, window_id, round(score, 6) AS score, label, predicted, record_count, array_to_string(list_sort(list_distinct(template_ids)), ' ') AS unique_templates FROM u"""),
    "conformal_threshold": sql(_CAL, "SELECT alpha, n_calibration, round(threshold, 6) AS threshold FROM tau"),
    "conformal_pvalues": sql(_CAL, "SELECT window_id, split, round((1 + (SELECT count(*) FROM cal WHERE cal.score >= q.score)) / CAST((SELECT count(*) FROM cal) + 1 AS DOUBLE), 6) AS p_value FROM scored0 q"),
    "calibrator_metadata": sql(_CAL, "SELECT count(*) AS n_calibration, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5::DOUBLE), 6) AS median_score FROM cal"),
    "gate_decisions": sql(_CAL, "SELECT window_id, split, CASE WHEN score > threshold THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS decision FROM scored0, tau WHERE alpha = 0.05::DOUBLE"),
    "alpha_sweep": sql(_CAL, _perf(f"SELECT alpha, any_value(threshold) AS threshold, {_COUNTS} FROM cal, tau GROUP BY alpha", "alpha,")),
    "ablation_fixed_quantile": sql(_CAL, _perf(f"SELECT threshold, {_COUNTS} FROM cal, (SELECT {_Q95} AS threshold) GROUP BY threshold", "'fixed_quantile' AS method,", alpha=False)),
    "ablation_models_one_gate": sql(B0_B2, f"""
, m AS (SELECT 'B0' AS model, score, y FROM scored0 WHERE split = 'calibration' UNION ALL SELECT 'B2', b2_score, CAST(is_anomaly AS INTEGER) FROM b2 JOIN win USING (window_id) WHERE split = 'calibration'),
o AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) AS k, count(*) OVER (PARTITION BY model) AS n FROM m),
a AS (SELECT CAST(unnest([0.01, 0.05, 0.10, 0.20]) AS DOUBLE) AS alpha),
t AS (SELECT model, alpha, min(score) AS threshold FROM o, a WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - alpha)))) GROUP BY ALL),
c AS (SELECT model, alpha, threshold, {_COUNTS} FROM m JOIN t USING (model) GROUP BY ALL)
SELECT model, alpha, round(threshold, 6) AS threshold, tp, fp, tn, fn, round((tp+fp) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS escalation_rate, round((tn+fn) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS coverage,
  CASE WHEN tn+fn > 0 THEN round(fn / CAST(tn+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS selective_risk FROM c"""),
    "ablation_calibration_size": sql(_CAL + f""",
seq AS (SELECT *, row_number() OVER (ORDER BY start_time) AS pos FROM cal),
sizes AS ({_size_rows()}),
sub AS (SELECT fraction, m, score, y, row_number() OVER (PARTITION BY fraction ORDER BY score) AS k FROM sizes JOIN seq ON pos <= m),
th AS (SELECT fraction, min(score) AS threshold FROM sub WHERE k = least(m, greatest(1, ceil((m + 1) * 0.95::DOUBLE))) GROUP BY 1),
c AS (SELECT fraction, m, threshold, {_COUNTS} FROM sub JOIN th USING (fraction) GROUP BY ALL)""", """
SELECT fraction, m AS sample_size, round(threshold, 6) AS threshold, round((tp+fp) / CAST(m AS DOUBLE), 6) AS escalation_rate, round((tn+fn) / CAST(m AS DOUBLE), 6) AS coverage,
  round(fn / CAST(tn+fn AS DOUBLE), 6) AS selective_risk, round(fn / CAST(m AS DOUBLE), 6) AS empirical_false_clear_rate, round(fn / CAST(m AS DOUBLE) - 0.05::DOUBLE, 6) AS deviation_from_nominal FROM c"""),
}


def _baseline(system: str, source: str, i: int) -> str:
    return f"""
SELECT 'events' AS dataset, '{system}' AS system, round(q{i}.threshold, 6) AS threshold, tp + fp AS flagged_windows, tp + fn AS total_anomalies, tp, fp, fn,
  CASE WHEN tp+fp > 0 THEN round(tp / CAST(tp+fp AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS precision, round(tp / CAST(tp+fn AS DOUBLE), 6) AS recall,
  CASE WHEN tp > 0 THEN round(2*tp / CAST(2*tp+fp+fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS f1, round(best{i}.f1, 6) AS oracle_best_f1, round(best{i}.threshold, 6) AS oracle_best_threshold,
  round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS pr_auc FROM (SELECT threshold, {_COUNTS} FROM {source}, q{i} GROUP BY threshold) c, q{i}, best{i}, rk{i}"""


def _two_systems() -> str:
    out = B0_B2 + """,
s0 AS (SELECT score, y FROM scored0 WHERE split = 'calibration'),
s1 AS (SELECT b2_score AS score, CAST(is_anomaly AS INTEGER) AS y FROM b2 JOIN win USING (window_id) WHERE split = 'calibration')"""
    for i in (0, 1):
        rank = ranking_sql(f"s{i}")
        for name in ("ps", "cum", "rk"):
            rank = rank.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name} ", f"FROM {name}{i} ").replace(f"FROM {name})", f"FROM {name}{i})")
        out += rank + _oracle_sql(f"s{i}", name=f"best{i}") + f", q{i} AS (SELECT quantile_cont(score, 0.95::DOUBLE) AS threshold FROM s{i})"
    return out


ORACLES["baseline_comparison"] = sql(_two_systems(), _baseline("B0", "s0", 0) + " UNION ALL " + _baseline("B2", "s1", 1))
