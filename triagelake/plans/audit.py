"""Queries over evaluation tables, drift, reviews, audit records and service metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize
from triagelake.operators import calibration as cal
from triagelake.operators import evaluation as ev
from triagelake.operators import monitoring as mon
from triagelake.operators import splits
from triagelake.plans import base, reason
from triagelake.plans import evidence as evp
from triagelake.plans.base import ALPHA, B0, RECORDS, rounded, sql
from triagelake.plans.reason import _FULL
from triagelake.plans.scoring import _COUNTS, B0_B2, ranking_sql
from triagelake.sources import tables


def _systems(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(long TEST predictions of all systems, all scored windows). Thresholds come from calibration."""
    w = base.scored_stage(spark, sf_dir, b2=True)
    c = w.filter(F.col("split") == "calibration")
    q0 = cal.quantile_threshold(c, 0.95, score="score").first()["threshold"]
    q2 = cal.quantile_threshold(c, 0.95, score="b2_score").first()["threshold"]
    tau = cal.threshold_map(c, [ALPHA], score="b2_score")[ALPHA]
    test = splits.read_split(w, "test", evaluate=True)

    def system(name: str, score: str, pred) -> F.Column:
        return F.struct(F.lit(name).alias("system"), F.col(score).alias("score"), pred.cast("int").alias("pred"))

    rows = F.array(
        system("B0", "score", F.col("score") > q0), system("B2", "b2_score", F.col("b2_score") > q2),
        system("B3", "b2_score", F.lit(True)), system("GATED", "b2_score", F.col("b2_score") > tau),
    )
    return test.select("dataset", "window_id", "y", F.inline(rows)), w


def classification_metrics(spark, sf):
    return rounded(ev.classification_metrics(_systems(spark, sf)[0], ["system"]))


def selective_metrics(spark, sf):
    long, _ = _systems(spark, sf)
    return rounded(ev.selective_metrics(cal.confusion(long, F.col("pred"), F.col("y"), ["system"])))


def ranking_metrics(spark, sf):
    return rounded(ev.ranking_metrics(_systems(spark, sf)[0], ["system"]))


def _labelled(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return d.join(tables.table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "score", F.col("toxic").alias("y"))


def label_ranking(spark, sf):
    """Ranking metrics with another base rate: text length against a document label, per language."""
    return rounded(ev.ranking_metrics(_labelled(spark, sf), ["lang"]))


def wilson(spark, sf):
    m = ev.classification_metrics(_systems(spark, sf)[0], ["system"]).withColumn("flagged", F.col("tp") + F.col("fp")).withColumn("actual", F.col("tp") + F.col("fn"))
    m = ev.wilson_interval(ev.wilson_interval(m, "tp", "flagged", prefix="precision"), "tp", "actual", 0.99, prefix="recall")
    return rounded(m.select("system", "precision_low", "precision_high", "recall_low", "recall_high"))


def _paired(spark, sf):
    long, _ = _systems(spark, sf)
    return long.groupBy("window_id", "y").agg(*[F.max(F.when(F.col("system") == s, F.col("pred"))).alias(s) for s in ("B0", "GATED")])


def mcnemar(spark, sf):
    return rounded(ev.mcnemar(_paired(spark, sf), "B0", "GATED", "y").drop("p_value", "accuracy_p_value"))


def mcnemar_p_values(spark, sf):
    return rounded(ev.mcnemar(_paired(spark, sf), "B0", "GATED", "y").select("p_value", "accuracy_p_value"))


def _benchmark(spark, sf):
    long, _ = _systems(spark, sf)
    return ev.benchmark_table(long)


def benchmark_table(spark, sf):
    return rounded(_benchmark(spark, sf).drop("dataset"))


def effect_sizes(spark, sf):
    b = materialize(_benchmark(spark, sf), "benchmark")
    return rounded(ev.effect_sizes(b, "B3").drop("dataset"))


def prediction_export(spark, sf):
    """Wide 0/1 predictions per window."""
    long, _ = _systems(spark, sf)
    return rounded(long.groupBy("window_id", "y").pivot("system", ["B0", "B2", "B3", "GATED"]).agg(F.first("pred")))


def precision_at_coverage(spark, sf):
    long, w = _systems(spark, sf)
    t = cal.threshold_map(w.filter(F.col("split") == "calibration"), score="b2_score")
    gated = long.filter(F.col("system") == "GATED")
    return rounded(ev.operating_points(gated, {f"alpha={a}": v for a, v in t.items()}))


def risk_coverage(spark, sf):
    long, _ = _systems(spark, sf)
    return rounded(ev.risk_coverage_curve(long.filter(F.col("system") == "GATED")))


def cost_model(spark, sf):
    m = ev.classification_metrics(_systems(spark, sf)[0], ["system"]).withColumn("escalated", F.col("tp") + F.col("fp"))
    return rounded(ev.cost_model(m, "total", "escalated").select("system", "expensive_calls", "auto_cleared_windows", "expensive_call_fraction", "total_compute_units", "call_reduction_ratio", "relative_cost_reduction_ratio"))


def bootstrap_ci(spark, sf):
    long, _ = _systems(spark, sf)
    hit = (F.col("pred") == 1) & (F.col("y") == 1)
    sums = {"tp": hit.cast("int"), "flagged": F.col("pred")}
    return rounded(ev.bootstrap_ci(long, sums, F.try_divide("tp", "flagged"), ["system"]))


def run_comparison(spark, sf):
    """Two runs over the same windows: systems B0 and GATED against B0 and B2."""
    m = materialize(ev.classification_metrics(_systems(spark, sf)[0], ["system"]), "metrics")
    return rounded(ev.compare_runs(m.filter(F.col("system").isin("B0", "GATED")), m.filter(F.col("system").isin("B0", "B2")), ["system"], ["precision", "recall"]))


def evaluation_ablations(spark, sf):
    """Without the gate, and with another score behind it: calls, precision and cost."""
    m = ev.cost_model(ev.classification_metrics(_systems(spark, sf)[0], ["system"]).withColumn("escalated", F.col("tp") + F.col("fp")), "total", "escalated")
    return rounded(m.select("system", "escalated", "precision", "call_reduction_ratio", "relative_cost_reduction_ratio"))


def dataset_statistics(spark, sf):
    w = base.event_windows(spark, sf)
    return rounded(w.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("record_count").alias("records"), F.count_if("is_anomaly").alias("anomalies"), F.avg(F.col("is_anomaly").cast("double")).alias("prevalence")))


# ---- drift ------------------------------------------------------------------------------------


def _periods(spark, sf):
    s = base.scored_stage(spark, sf)
    return s.filter(F.col("split") == "calibration"), s.filter(F.col("split") == "test")


def psi(spark, sf):
    return rounded(mon.psi_bins(*_periods(spark, sf)))


def drift_verdict(spark, sf):
    return rounded(mon.drift_verdict(*_periods(spark, sf)))


def drift_reference(spark, sf):
    ref, _ = _periods(spark, sf)
    r = mon.drift_reference(ref)
    return rounded(ref.agg(F.count(F.lit(1)).alias("n"), F.lit(r["threshold"]).alias("threshold"), F.lit(r["escalation_rate"]).alias("escalation_rate")))


def density_histogram(spark, sf):
    return rounded(mon.density_histogram(base.scored_stage(spark, sf), by=["split"]))


# ---- reviews ----------------------------------------------------------------------------------


def _reviews(spark, sf):
    o = tables.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("inc_"), F.col("o_custkey")).alias("incident_id"), F.col("o_orderpriority").alias("reviewer_id"), F.lit("ESCALATE").alias("machine_decision"),
        F.when(status == "F", "CONFIRM").when(status == "O", "REJECT").otherwise("NEEDS_REVIEW").alias("human_decision"),
        F.when(status != "F", F.concat(F.lit("reason "), F.substring("o_orderpriority", 1, 1))).alias("reason"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
    )


def review_upsert(spark, sf):
    return mon.latest_reviews(_reviews(spark, sf), ("ts", "seq")).select("incident_id", "reviewer_id", "human_decision", "reason", "seq")


def review_summary(spark, sf):
    return rounded(mon.review_summary(mon.latest_reviews(_reviews(spark, sf), ("ts", "seq"))))


def review_reasons(spark, sf):
    return mon.review_reasons(mon.latest_reviews(_reviews(spark, sf), ("ts", "seq")))


# ---- audit ------------------------------------------------------------------------------------


def _assessed(spark, sf) -> tuple[DataFrame, float]:
    e = evp.evidence(spark, sf)
    a = reason.rs.assess(materialize(reason.incidents(e, evp.bundles(e)), "incidents"))
    tau = cal.threshold_map(e["gated"], [ALPHA], score="b2_score")[ALPHA]
    return materialize(a, "assessed"), tau


def evidence_graph_nodes(spark, sf):
    nodes, _ = mon.evidence_graph(*_assessed(spark, sf))
    return nodes.select("incident_id", "id", "type", "status")


def evidence_graph_edges(spark, sf):
    _, edges = mon.evidence_graph(*_assessed(spark, sf))
    return edges


def evidence_graph_check(spark, sf):
    nodes, edges = mon.evidence_graph(*_assessed(spark, sf))
    return mon.dangling_edges(nodes, edges).agg(F.count(F.lit(1)).alias("dangling"))


def _passports(spark, sf):
    a, tau = _assessed(spark, sf)
    rows = a.select("dataset", "window_id", "anomaly_score", "final_decision", "severity", F.when(F.col("is_escalated"), evp.K).otherwise(0).alias("retrieval_count"), "evidence_count",
                    F.col("evidence_count").alias("citation_count"), F.when(F.col("is_escalated"), "VERIFIED").otherwise("NOT_APPLICABLE").alias("faithfulness_status"))
    return mon.passports(rows, tau)


def passports(spark, sf):
    return rounded(_passports(spark, sf).drop("dataset", "code_version"))


def passport_verify(spark, sf):
    """Passports whose severity was changed afterwards where the score is high."""
    p = _passports(spark, sf)
    forged = p.withColumn("severity", F.when(F.col("anomaly_score") > F.col("threshold"), "FORGED").otherwise(F.col("severity")))
    return mon.verify_passports(forged).select("incident_id", "authentic", "problem")


def replay_join(spark, sf):
    e = evp.evidence(spark, sf)
    b = materialize(evp.bundles(e), "bundles")
    a = reason.rs.assess(materialize(reason.incidents(e, b), "incidents"))
    done = a.filter("is_escalated").select("dataset", "window_id", F.lit("GENERATED").alias("explanation_status"))
    return rounded(mon.replay(a, b.withColumnRenamed("query_id", "window_id"), done).drop("dataset"))


def counterfactual(spark, sf):
    w = base.scored_stage(spark, sf)
    c = w.filter(F.col("split") == "calibration")
    t = cal.threshold_map(c, [ALPHA])[ALPHA]
    return rounded(mon.counterfactuals(c.withColumn("anomaly_score", F.col("score")), [1.0, 1.6, 2.0], t).drop("margin"))


def window_lookup(spark, sf):
    """Each user's lines ask for the session window of that user; every third also names an id."""
    from triagelake.operators import windows

    lines = tables.event_lines(spark, sf)
    r = tables.event_records(spark, sf).withColumn("session_id", F.concat(F.lit("blk_"), F.col("user_id")))
    w = windows.session_windows(r, prefix="session").select("window_id", "session_id")
    asked = F.when(F.col("line_number") % 3 == 0, F.lit("session_blk_0")).otherwise(F.lit("unknown"))
    return mon.lookup_windows(lines.select(F.col("line_number").alias("request_id"), asked.alias("window_id"), F.col("raw_text").alias("text")), w)


def invariant_audit(spark, sf):
    a, _ = _assessed(spark, sf)
    later = a.select("dataset", "window_id", "final_decision", F.when(F.col("is_escalated"), "HIGH").otherwise(F.col("severity")).alias("severity"))
    return mon.invariant_audit(a, later, ["dataset", "window_id"], ["final_decision", "severity"])


# ---- service metrics --------------------------------------------------------------------------


def _service(spark, sf):
    return tables.event_records(spark, sf).select("dataset", F.col("template").alias("stage"), F.col("user_id"), F.col("value"), F.when(F.col("is_anomaly"), "ESCALATE").otherwise("AUTO-CLEAR").alias("decision"))


def labelled_counters(spark, sf):
    return rounded(mon.labelled_counters(_service(spark, sf), ["dataset", "stage", "user_id", "decision"], "value"))


def latency_histogram(spark, sf):
    return rounded(mon.bucket_histogram(_service(spark, sf), "value", [1.0, 5.0, 25.0, 100.0, 250.0], ["stage"]).filter(F.col("le") < float("inf")))


def latency_histogram_open(spark, sf):
    return rounded(mon.bucket_histogram(_service(spark, sf), "value", [1.0, 5.0, 25.0, 100.0, 250.0], ["stage"], inclusive=False).filter(F.col("le") < float("inf")))


def service_indicators(spark, sf):
    s = _service(spark, sf)
    return rounded(mon.service_indicators(s, F.col("stage") != "error", F.col("decision") == "ESCALATE", ["dataset"]))


def escalation_gauge(spark, sf):
    return mon.escalation_gauge(_service(spark, sf), ["stage"])


QUERIES = {
    f.__name__: f
    for f in (
        classification_metrics, selective_metrics, ranking_metrics, label_ranking, wilson, mcnemar, mcnemar_p_values, benchmark_table, effect_sizes, prediction_export,
        precision_at_coverage, risk_coverage, cost_model, bootstrap_ci, run_comparison, evaluation_ablations, dataset_statistics, psi, drift_verdict, drift_reference,
        density_histogram, review_upsert, review_summary, review_reasons, evidence_graph_nodes, evidence_graph_edges, evidence_graph_check, passports, passport_verify,
        replay_join, counterfactual, window_lookup, invariant_audit, labelled_counters, latency_histogram, latency_histogram_open, service_indicators, escalation_gauge,
    )
}

_SYS = B0_B2 + """,
call AS (SELECT s.window_id, s.score, b2_score FROM scored0 s JOIN b2 USING (window_id) WHERE split = 'calibration'),
q AS (SELECT quantile_cont(score, 0.95::DOUBLE) AS q0, quantile_cont(b2_score, 0.95::DOUBLE) AS q2 FROM call),
o2 AS (SELECT b2_score AS s, row_number() OVER (ORDER BY b2_score) AS k, count(*) OVER () AS n FROM call),
alph AS (SELECT CAST(unnest([0.01, 0.05, 0.1, 0.2]) AS DOUBLE) AS alpha),
taus AS (SELECT alpha, min(s) AS tau FROM alph, o2 WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - alpha)))) GROUP BY 1),
tst AS (SELECT s.window_id, s.y, s.score AS s0, b2_score AS s2 FROM scored0 s JOIN b2 USING (window_id) WHERE split = 'test'),
long AS (
  SELECT window_id, y, 'B0' AS system, s0 AS score, CAST(s0 > q0 AS INTEGER) AS pred FROM tst, q UNION ALL SELECT window_id, y, 'B2', s2, CAST(s2 > q2 AS INTEGER) FROM tst, q
  UNION ALL SELECT window_id, y, 'B3', s2, 1 FROM tst UNION ALL SELECT window_id, y, 'GATED', s2, CAST(s2 > tau AS INTEGER) FROM tst, taus WHERE alpha = 0.05::DOUBLE),
cf AS (SELECT system, count(*) FILTER (WHERE pred = 1 AND y = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND y = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND y = 0) AS tn, count(*) FILTER (WHERE pred = 0 AND y = 1) AS fn FROM long GROUP BY 1),
met AS (
  SELECT *, tp+fp+tn+fn AS total, tp+fp AS escalated, CASE WHEN tp+fp > 0 THEN tp / CAST(tp+fp AS DOUBLE) END AS precision, CASE WHEN tp+fn > 0 THEN tp / CAST(tp+fn AS DOUBLE) END AS recall,
    CASE WHEN tp+fp > 0 AND tp+fn > 0 THEN 2*tp / CAST(2*tp+fp+fn AS DOUBLE) END AS f1, CASE WHEN fp+tn > 0 THEN fp / CAST(fp+tn AS DOUBLE) END AS fpr, CASE WHEN tp+fn > 0 THEN fn / CAST(tp+fn AS DOUBLE) END AS fnr,
    (tp+tn) / CAST(tp+fp+tn+fn AS DOUBLE) AS accuracy, fn / CAST(tp+fp+tn+fn AS DOUBLE) AS fcr FROM cf),
cost AS (SELECT *, escalated AS expensive_calls, total - escalated AS cleared, escalated / CAST(total AS DOUBLE) AS frac, total + escalated * 55.0::DOUBLE AS units, (total - escalated) / CAST(total AS DOUBLE) AS callred,
  (total * 56.0::DOUBLE - (total + escalated * 55.0::DOUBLE)) / (total * 56.0::DOUBLE) AS costred FROM met)"""


def _wilson(k: str, n: str, z: str, side: str) -> str:
    p, b = f"({k} / CAST({n} AS DOUBLE))", f"(1 + {z} * {z} / {n})"
    c = f"(({p} + {z} * {z} / (2 * {n})) / {b})"
    s = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})) / {b})"
    edge = f"WHEN {k} = 0 THEN 0.0::DOUBLE" if side == "low" else f"WHEN {k} = {n} THEN 1.0::DOUBLE"
    val = f"greatest(0.0::DOUBLE, {c} - {s})" if side == "low" else f"least(1.0::DOUBLE, {c} + {s})"
    return f"CASE WHEN {n} <= 0 THEN NULL {edge} ELSE round({val}, 6) END"


Z95, Z99 = "1.959963984540054::DOUBLE", "2.5758293035489004::DOUBLE"


def _ranking_by(source: str, key: str) -> str:
    return f""",
ps AS (SELECT {key}, score AS s, count(*) AS c, sum(y) AS p FROM {source} GROUP BY ALL),
cum AS (SELECT {key}, s, c, p, sum(c) OVER (PARTITION BY {key} ORDER BY s DESC) AS nge, sum(p) OVER (PARTITION BY {key} ORDER BY s DESC) AS tp, sum(c) OVER (PARTITION BY {key}) AS n, sum(p) OVER (PARTITION BY {key}) AS pt FROM ps),
rk AS (
  SELECT {key}, CASE WHEN max(pt) > 0 AND max(n - pt) > 0 THEN sum(p * ((n - pt) - (nge - tp) + (c - p) / 2.0::DOUBLE) / nullif(CAST(pt AS DOUBLE) * (n - pt), 0)) END AS roc_auc,
    CASE WHEN max(pt) > 0 AND max(n - pt) > 0 THEN sum(p / nullif(CAST(pt AS DOUBLE), 0) * (tp / CAST(nge AS DOUBLE) + CASE WHEN nge > c THEN (tp - p) / CAST(nge - c AS DOUBLE) ELSE 1.0::DOUBLE END) / 2.0::DOUBLE) END AS pr_auc,
    CASE WHEN max(pt) > 0 AND max(n - pt) > 0 THEN sum(p / nullif(CAST(pt AS DOUBLE), 0) * tp / CAST(nge AS DOUBLE)) END AS average_precision FROM cum GROUP BY 1)"""


_LAB = "lab AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score, toxic AS y FROM documents JOIN labels USING (doc_id))"
_OP = """round((tp+fp) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS {esc}, round((tn+fn) / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS auto_clear_coverage, {mid}
  CASE WHEN tn+fn > 0 THEN round(fn / CAST(tn+fn AS DOUBLE), 6) END AS selective_risk, round(fn / CAST(tp+fp+tn+fn AS DOUBLE), 6) AS empirical_false_clear_rate"""
_PAIR = ", pr AS (SELECT window_id, y, max(pred) FILTER (WHERE system = 'B0') AS a, max(pred) FILTER (WHERE system = 'GATED') AS b FROM long GROUP BY ALL), mc AS (SELECT count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = y AND b <> y) AS oa, count(*) FILTER (WHERE a <> y AND b = y) AS ob FROM pr)"


def _chi(b: str, c: str) -> str:
    return f"CASE WHEN {b} + {c} > 0 THEN pow(greatest(0.0::DOUBLE, abs({b} - {c}) - 1.0::DOUBLE), 2) / ({b} + {c}) ELSE 0.0::DOUBLE END"


_PSI = B0 + """,
ref AS (SELECT score FROM scored0 WHERE split = 'calibration'), cur AS (SELECT score FROM scored0 WHERE split = 'test'),
ed AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM ref),
inn AS (SELECT e[2:len(e) - 1] AS e FROM ed),
bins AS (SELECT CAST(unnest(range(len(e) + 1)) AS INTEGER) AS bin_index, len(e) + 1 AS k FROM inn),
rb AS (SELECT len(list_filter(e, lambda x: x <= score)) AS b, count(*) AS c FROM ref, inn GROUP BY 1), cb AS (SELECT len(list_filter(e, lambda x: x <= score)) AS b, count(*) AS c FROM cur, inn GROUP BY 1),
ct AS (SELECT bin_index, k, coalesce(rb.c, 0) AS r, coalesce(cb.c, 0) AS c FROM bins LEFT JOIN rb ON rb.b = bin_index LEFT JOIN cb ON cb.b = bin_index),
sh AS (SELECT bin_index, r, c, (r + 0.0001::DOUBLE) / (sum(r) OVER () + 0.0001::DOUBLE * k) AS rp, (c + 0.0001::DOUBLE) / (sum(c) OVER () + 0.0001::DOUBLE * k) AS cp FROM ct),
tt AS (SELECT min(score) AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM ref) WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - 0.05::DOUBLE)))))"""

_REV = """
rv AS (SELECT 'inc_' || o_custkey AS incident_id, o_orderpriority AS reviewer_id, CASE o_orderstatus WHEN 'F' THEN 'CONFIRM' WHEN 'O' THEN 'REJECT' ELSE 'NEEDS_REVIEW' END AS human_decision,
  CASE WHEN o_orderstatus = 'F' THEN 'Agreed with machine triage' ELSE 'reason ' || left(o_orderpriority, 1) END AS reason, o_orderkey AS seq,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
lt AS (SELECT * FROM rv WHERE rn = 1)"""


def _node(kind: str, src: str, key: str, status: str) -> str:
    return f"SELECT window_id AS incident_id, 'node:{kind}:' || {key} AS id, '{kind}' AS type, {status} AS status FROM {src}"


_GRAPH = _FULL + ", ac AS (SELECT c.query_id AS window_id, c.query_id || '/' || citation_id AS k FROM cit c), e AS (SELECT * FROM ass WHERE esc)"
_NODES = " UNION ALL ".join([
    _node("incident", "ass", "window_id", "'ACTIVE'"), _node("window", "ass", "window_id", "'PARSED'"), _node("score", "ass", "window_id", "'COMPUTED'"),
    _node("decision", "ass", "window_id", "CASE WHEN esc THEN 'ESCALATED' ELSE 'CLEARED' END"), _node("retrieval", "e", "window_id", "'INDEX_SEARCHED'"), _node("evidence", "e", "window_id", "'SELECTED'"),
    _node("provenance", "e", "window_id", "'VERIFIED'"), _node("reasoning", "e", "window_id", "dec"), _node("citation", "ac", "k", "'VALID'"), _node("source_log", "ac", "k", "'TRAIN_SPLIT_RECORD'")])


def _edge(a: str, b: str, label: str, src: str, ak: str = "window_id", bk: str = "window_id") -> str:
    return f"SELECT window_id AS incident_id, 'node:{a}:' || {ak} AS source, 'node:{b}:' || {bk} AS target, '{label}' AS label FROM {src}"


_EDGES = " UNION ALL ".join([
    _edge("incident", "window", "evaluates", "ass"), _edge("window", "score", "computes_signal", "ass"), _edge("score", "decision", "gates_through", "ass"), _edge("decision", "retrieval", "triggers_retrieval", "e"),
    _edge("retrieval", "evidence", "diversifies", "e"), _edge("evidence", "provenance", "verifies_hashes", "e"), _edge("provenance", "reasoning", "informs_reasoning", "e"),
    _edge("reasoning", "citation", "cites_evidence", "ac", "window_id", "k"), _edge("citation", "source_log", "points_to_source", "ac", "k", "k")])

_PASS = _FULL + """,
pp AS (
  SELECT window_id, round(a, 4) AS anomaly_score, 0.05::DOUBLE AS calibration_alpha, round(tau, 5) AS threshold, CASE WHEN a > tau THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS conformal_decision, dec AS final_decision, sev AS severity,
    CASE WHEN a > tau THEN 'SELECTIVELY_ESCALATED' ELSE 'AUTO_CLEARED' END AS escalation_state, CAST(CASE WHEN esc THEN 5 ELSE 0 END AS BIGINT) AS retrieval_count, n AS evidence_count, n AS citation_count,
    CASE WHEN esc THEN 'VERIFIED' ELSE 'NOT_APPLICABLE' END AS faithfulness_status, left(sha256('alpha=0.05:thresh=' || printf('%.5f', tau) || ':dataset=events:version=1.0'), 16) AS configuration_hash,
    left(sha256(window_id || ':' || CASE WHEN esc THEN 5 ELSE 0 END || ':' || n || ':' || n), 16) AS evidence_hash FROM ass, tau2),
ph AS (SELECT *, sha256(window_id || '|events|' || window_id || '|' || printf('%.4f', anomaly_score) || '|' || printf('%.5f', threshold) || '|' || conformal_decision || '|' || final_decision || '|' || severity || '|' || configuration_hash || '|' || evidence_hash || '|unknown') AS decision_hash FROM pp)"""

_STAGE_SQL = " UNION ALL ".join(
    f"SELECT window_id, CAST({i} AS BIGINT) AS stage_index, '{name}' AS stage, {('CASE WHEN esc THEN ' + chr(39) + 'COMPLETED' + chr(39) + ' ELSE ' + chr(39) + 'SKIPPED' + chr(39) + ' END') if skips else chr(39) + 'COMPLETED' + chr(39)} AS status FROM ass"
    for i, (name, skips) in enumerate(mon.REPLAY_STAGES, 1)
)

_SVC = RECORDS + ", svc AS (SELECT dataset, template AS stage, value, CASE WHEN is_anomaly THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS decision FROM rec)"


def _hist(op: str) -> str:
    return f"SELECT stage, count(*) AS count, round(sum(value), 6) AS sum, le, count(*) FILTER (WHERE value {op} le) AS cumulative FROM svc, (SELECT CAST(unnest([1, 5, 25, 100, 250]) AS DOUBLE) AS le) GROUP BY stage, le"


ORACLES = {
    "classification_metrics": sql(_SYS, "SELECT system, tp, fp, tn, fn, total, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(accuracy, 6) AS accuracy, round(fcr, 6) AS empirical_false_clear_rate FROM met"),
    "selective_metrics": sql(_SYS, """SELECT system, tp, fp, tn, fn, total AS total_windows, escalated AS escalated_windows, tn+fn AS cleared_windows, round(escalated / CAST(total AS DOUBLE), 6) AS escalation_rate, round((tn+fn) / CAST(total AS DOUBLE), 6) AS auto_clear_rate,
  round(fcr, 6) AS empirical_false_clear_rate, CASE WHEN tn+fn > 0 THEN round(fn / CAST(tn+fn AS DOUBLE), 6) END AS selective_risk, round(precision, 6) AS precision_escalated, round(recall, 6) AS recall_escalated FROM met"""),
    "ranking_metrics": sql(_SYS + _ranking_by("long", "system"), "SELECT system, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision FROM rk"),
    "label_ranking": sql(_LAB + _ranking_by("lab", "lang"), "SELECT lang, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision FROM rk"),
    "wilson": sql(_SYS, f"SELECT system, {_wilson('tp', '(tp+fp)', Z95, 'low')} AS precision_low, {_wilson('tp', '(tp+fp)', Z95, 'high')} AS precision_high, {_wilson('tp', '(tp+fn)', Z99, 'low')} AS recall_low, {_wilson('tp', '(tp+fn)', Z99, 'high')} AS recall_high FROM met"),
    "mcnemar": sql(_SYS + _PAIR, f"SELECT n11 AS pos_a_pos_b, n10 AS pos_a_neg_b, n01 AS neg_a_pos_b, n00 AS neg_a_neg_b, oa AS only_a_correct, ob AS only_b_correct, round({_chi('n10', 'n01')}, 6) AS statistic, ({_chi('n10', 'n01')}) > 3.841458820694124::DOUBLE AS significant_at_05, round({_chi('oa', 'ob')}, 6) AS accuracy_statistic FROM mc"),
    "benchmark_table": sql(_SYS + _ranking_by("long", "system"), f"""
SELECT system, tp, fp, tn, fn, total, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(accuracy, 6) AS accuracy, round(fcr, 6) AS empirical_false_clear_rate, escalated, expensive_calls,
  cleared AS auto_cleared_windows, round(frac, 6) AS expensive_call_fraction, units AS total_compute_units, round(callred, 6) AS call_reduction_ratio, round(costred, 6) AS relative_cost_reduction_ratio, {_wilson('tp', '(tp+fp)', Z95, 'low')} AS precision_ci_low,
  {_wilson('tp', '(tp+fp)', Z95, 'high')} AS precision_ci_high, {_wilson('tp', '(tp+fn)', Z95, 'low')} AS recall_ci_low, {_wilson('tp', '(tp+fn)', Z95, 'high')} AS recall_ci_high, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision
FROM cost JOIN rk USING (system)"""),
    "effect_sizes": sql(_SYS, """SELECT c.system, round(c.precision - b.precision, 6) AS delta_precision, round(c.recall - b.recall, 6) AS delta_recall, round(c.fpr - b.fpr, 6) AS delta_fpr, round(c.fcr - b.fcr, 6) AS delta_empirical_false_clear_rate,
  round((b.expensive_calls - c.expensive_calls) / CAST(b.expensive_calls AS DOUBLE), 6) AS expensive_call_reduction_ratio FROM cost c, cost b WHERE b.system = 'B3' AND c.system <> 'B3'"""),
    "prediction_export": sql(_SYS, 'SELECT window_id, CAST(y AS BIGINT) AS y, CAST(max(pred) FILTER (WHERE system = \'B0\') AS BIGINT) AS "B0", CAST(max(pred) FILTER (WHERE system = \'B2\') AS BIGINT) AS "B2", CAST(max(pred) FILTER (WHERE system = \'B3\') AS BIGINT) AS "B3", CAST(max(pred) FILTER (WHERE system = \'GATED\') AS BIGINT) AS "GATED" FROM long GROUP BY ALL'),
    "precision_at_coverage": sql(_SYS + f", pc AS (SELECT alpha, tau AS threshold, {_COUNTS} FROM (SELECT y, s2 AS score, alpha, tau, tau AS threshold FROM tst, taus) GROUP BY alpha, tau)",
        "SELECT 'alpha=' || alpha AS operating_point, round(threshold, 6) AS threshold, tp, fp, tn, fn, " + _OP.format(esc="escalation_coverage", mid="CASE WHEN tp+fp > 0 THEN round(tp / CAST(tp+fp AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS precision, round(tp / CAST(tp+fn AS DOUBLE), 6) AS recall, round(fp / CAST(fp+tn AS DOUBLE), 6) AS fpr,") + " FROM pc"),
    "risk_coverage": sql(_SYS + f", mm AS (SELECT min(s2) AS lo, max(s2) AS hi FROM tst), g AS (SELECT CAST(i AS BIGINT) AS step, CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END AS threshold FROM mm, range(20) t(i)), rc AS (SELECT step, threshold, {_COUNTS} FROM (SELECT y, s2 AS score, step, threshold FROM tst, g) GROUP BY step, threshold)",
        "SELECT step, round(threshold, 6) AS threshold, " + _OP.format(esc="escalation_rate", mid="") + " FROM rc"),
    "cost_model": sql(_SYS, "SELECT system, expensive_calls, cleared AS auto_cleared_windows, round(frac, 6) AS expensive_call_fraction, units AS total_compute_units, round(callred, 6) AS call_reduction_ratio, round(costred, 6) AS relative_cost_reduction_ratio FROM cost"),
    "run_comparison": sql(_SYS, """SELECT coalesce(l.system, r.system) AS system, CASE WHEN r.system IS NULL THEN 'left_only' WHEN l.system IS NULL THEN 'right_only' ELSE 'both' END AS presence, round(l.precision, 6) AS precision_left, round(r.precision, 6) AS precision_right,
  round(r.precision - l.precision, 6) AS precision_delta, round(l.recall, 6) AS recall_left, round(r.recall, 6) AS recall_right, round(r.recall - l.recall, 6) AS recall_delta
FROM (SELECT * FROM met WHERE system IN ('B0', 'GATED')) l FULL JOIN (SELECT * FROM met WHERE system IN ('B0', 'B2')) r ON l.system = r.system"""),
    "evaluation_ablations": sql(_SYS, "SELECT system, escalated, round(precision, 6) AS precision, round(callred, 6) AS call_reduction_ratio, round(costred, 6) AS relative_cost_reduction_ratio FROM cost"),
    "dataset_statistics": sql(base.WINDOWS, "SELECT dataset, split, count(*) AS windows, CAST(sum(record_count) AS BIGINT) AS records, count(*) FILTER (WHERE is_anomaly) AS anomalies, round(avg(CAST(is_anomaly AS INTEGER)), 6) AS prevalence FROM win GROUP BY ALL"),
    "psi": sql(_PSI, "SELECT CAST(bin_index AS BIGINT) AS bin_index, r AS reference_count, c AS current_count, round(rp, 6) AS reference_share, round(cp, 6) AS current_share, round((cp - rp) * ln(cp / rp), 6) AS contribution FROM sh"),
    "drift_verdict": sql(_PSI, """
, p AS (SELECT sum((cp - rp) * ln(cp / rp)) AS psi FROM sh),
r AS (SELECT count(*) AS n, avg(score) AS m, stddev_pop(score) AS sd, avg(CAST(score > t AS INTEGER)) AS rate, quantile_cont(score, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM ref, tt),
c AS (SELECT count(*) AS n, avg(score) AS m, stddev_pop(score) AS sd, avg(CAST(score > t AS INTEGER)) AS rate, quantile_cont(score, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM cur, tt),
d AS (SELECT *, CASE WHEN c.n < 20 THEN 'INSUFFICIENT DATA' WHEN psi >= 0.25 OR abs(c.rate - r.rate) > 0.15 THEN 'DRIFT DETECTED' WHEN psi >= 0.1 OR abs(c.rate - r.rate) > 0.05 THEN 'WATCH' ELSE 'STABLE' END AS st FROM p, tt, r, c)
SELECT st AS drift_status, st IN ('DRIFT DETECTED', 'WATCH') AS review_required, c.n AS sample_size, r.n AS reference_sample_size, round(psi, 4) AS psi, round(t, 6) AS threshold, round(c.rate, 4) AS current_escalation_rate, round(c.rate - r.rate, 4) AS escalation_rate_delta,
  round(c.m - r.m, 4) AS mean_shift, round(c.q[2] - r.q[2], 4) AS median_shift, round(c.sd - r.sd, 4) AS std_shift, round(c.q[1] - r.q[1], 4) AS p25_shift, round(c.q[2] - r.q[2], 4) AS p50_shift, round(c.q[3] - r.q[3], 4) AS p75_shift,
  round(c.q[4] - r.q[4], 4) AS p90_shift, round(c.q[5] - r.q[5], 4) AS p95_shift, round(c.q[6] - r.q[6], 4) AS p99_shift FROM p, tt, r, c, (SELECT st FROM d)"""),
    "drift_reference": sql(_PSI, "SELECT count(*) AS n, round(any_value(t), 6) AS threshold, round(avg(CAST(score > t AS INTEGER)), 6) AS escalation_rate FROM ref, tt"),
    "density_histogram": sql(B0, """
, h AS (SELECT split, least(CAST(floor(score / 0.25::DOUBLE) AS BIGINT), 13) AS bin, count(*) AS c FROM scored0 WHERE score BETWEEN 0 AND 3.5 GROUP BY ALL),
g AS (SELECT split, b AS bin FROM (SELECT DISTINCT split FROM scored0), range(14) t(b))
SELECT split, bin, bin * 0.25::DOUBLE AS low, coalesce(c, 0) AS count, round(coalesce(c, 0) / (sum(coalesce(c, 0)) OVER (PARTITION BY split) * 0.25::DOUBLE), 6) AS density FROM g LEFT JOIN h USING (split, bin)"""),
    "review_upsert": sql(_REV, "SELECT incident_id, reviewer_id, human_decision, reason, seq FROM lt"),
    "review_summary": sql(_REV, "SELECT count(*) AS total_reviews, count(*) FILTER (WHERE human_decision = 'CONFIRM') AS confirm_count, count(*) FILTER (WHERE human_decision = 'REJECT') AS reject_count, count(*) FILTER (WHERE human_decision = 'NEEDS_REVIEW') AS needs_review_count, round(count(*) FILTER (WHERE human_decision = 'CONFIRM') / CAST(count(*) AS DOUBLE), 4) AS human_agreement_rate FROM lt"),
    "review_reasons": sql(_REV, "SELECT reason, count(*) AS n FROM lt GROUP BY 1"),
    "evidence_graph_nodes": sql(_GRAPH, _NODES),
    "evidence_graph_edges": sql(_GRAPH, _EDGES),
    "evidence_graph_check": "SELECT count(*) AS dangling FROM events WHERE event_id < 0",
    "passports": sql(_PASS, "SELECT window_id AS incident_id, window_id, anomaly_score, calibration_alpha, threshold, conformal_decision, final_decision, severity, escalation_state, retrieval_count, evidence_count, citation_count, faithfulness_status, configuration_hash, evidence_hash, decision_hash, 'VERIFIED' AS status FROM ph"),
    "passport_verify": sql(_PASS, "SELECT window_id AS incident_id, NOT (anomaly_score > threshold) AS authentic, CASE WHEN anomaly_score > threshold THEN 'hash mismatch' END AS problem FROM ph"),
    "replay_join": sql(_FULL, _STAGE_SQL),
    "counterfactual": sql(_PSI, """SELECT window_id, round(score, 6) AS actual_score, h AS hypothetical_score, CASE WHEN score > t THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS actual_decision, CASE WHEN h > t THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS hypothetical_decision,
  (score > t) <> (h > t) AS decision_changed FROM scored0, tt, (SELECT CAST(unnest([1.0, 1.6, 2.0]) AS DOUBLE) AS h) WHERE split = 'calibration'"""),
    "window_lookup": """
WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT event_id + 1 AS request_id, CASE WHEN (event_id + 1) % 3 = 0 AND EXISTS (SELECT 1 FROM u WHERE u.user_id = 0) THEN 'session_blk_0' ELSE 'session_blk_' || user_id END AS resolved_window_id,
  CASE WHEN (event_id + 1) % 3 = 0 AND EXISTS (SELECT 1 FROM u WHERE u.user_id = 0) THEN 'window_id' ELSE 'session_key' END AS resolved_by FROM events""",
    "invariant_audit": sql(_FULL, "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS final_decision_mismatches, count(*) FILTER (WHERE esc AND sev <> 'HIGH') AS severity_mismatches FROM ass"),
    "labelled_counters": sql(_SVC, "SELECT dataset, stage, decision, round(sum(value), 6) AS total, count(*) AS observations FROM svc GROUP BY ALL"),
    "latency_histogram": sql(_SVC, _hist("<=")),
    "latency_histogram_open": sql(_SVC, _hist("<")),
    "service_indicators": sql(_SVC, "SELECT dataset, count(*) AS requests, round(count(*) FILTER (WHERE stage <> 'error') / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(count(*) FILTER (WHERE decision = 'ESCALATE') / CAST(count(*) AS DOUBLE), 6) AS escalation_rate FROM svc GROUP BY 1"),
    "escalation_gauge": sql(_SVC, "SELECT stage, round(count(*) FILTER (WHERE decision = 'ESCALATE') / CAST(count(*) AS DOUBLE), 4) AS escalation_rate FROM svc GROUP BY 1"),
}
