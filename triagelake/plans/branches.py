"""Incidents derived from orders that take every branch of the assessment, and citations that trip every guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import provenance as prov
from triagelake.operators import reasoning as rs
from triagelake.operators import retrieval as ret
from triagelake.plans import base
from triagelake.plans.base import WINDOWS, rounded, sql
from triagelake.sources import tables

#: digest of an artifact that citations name
ARTIFACT = "a" * 64


def incident_grid(spark, sf: str) -> DataFrame:
    """Every order as a gated window: scores, evidence and faults of its bundle follow from its keys."""
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    fault = F.col("k") % 13
    n = (F.col("c") % 4).cast("int")
    window = F.concat(F.lit("order_"), "k")

    def citation(i):
        source, chunk = F.concat_ws("_", F.lit("src"), "k", i.cast("string")), F.sha2(F.concat_ws("_", "k", i.cast("string")), 256)
        start = F.col("k") + i
        right = prov.citation_id(F.lit("orders"), F.lit("train"), chunk, source, start, start + 4)
        relevance = ((F.col("k") + 7 * i) % 9) / F.lit(8.0)
        return F.struct(
            i.alias("selected_rank"), F.when(fault == 4, F.reverse(right)).otherwise(right).alias("citation_id"), F.concat(F.lit("["), source, F.lit("]")).alias("citation_text"), chunk.alias("chunk_id"), source.alias("source_window_id"),
            relevance.alias("retrieval_score"), (relevance - ((F.col("c") + i) % 8) / F.lit(8.0)).alias("selection_score"),
            F.struct(start.alias("line_start"), (start + 4).alias("line_end"), F.lit(5).cast("long").alias("record_count")).alias("source_location"),
            F.when(fault == 3, F.lit("short")).otherwise(chunk).alias("source_content_hash"), chunk.alias("template_content_hash"), F.lit("VALID").alias("status"),
        )

    some = F.transform(F.sequence(F.lit(1), n), citation)
    cited = F.when(n > 0, some).otherwise(F.slice(some, 1, 0))
    return o.select(
        F.lit("orders").alias("dataset"), F.lit("calibration").alias("split"), window.alias("window_id"), F.lit(None).cast("string").alias("session_id"), (F.col("k") % 9 + 1).alias("record_count"), (F.col("k") % 3 % (F.col("k") % 9 + 1) + 1).alias("unique_templates"),
        (F.col("k") % 17 == 0).alias("has_unknown_template"), F.lit(0.0).alias("start_time"), (F.col("c") % 60).cast("double").alias("end_time"), ((F.col("c") % 25) / F.lit(8.0)).alias("anomaly_score"), ((F.col("k") % 20) / F.lit(8.0)).alias("b0_score"),
        F.when(F.col("k") % 5 == 0, "AUTO-CLEAR").otherwise("ESCALATE").alias("decision"), F.when(fault != 5, F.sha2(window, 256)).alias("bundle_id"), F.when(fault != 5, cited).alias("citations"),
        F.when(fault == 1, "other").otherwise("orders").alias("bundle_dataset"), F.when(fault == 2, "test").otherwise("train").alias("bundle_split"), (fault != 0).alias("all_verified"),
    )


def assessment_grid(spark, sf):
    a = rs.assess(incident_grid(spark, sf))
    return rounded(a.select("window_id", "final_decision", "severity", "confidence", "agreement_score", "agreement_level", "rule_fired", F.array_join("rules_evaluated", ",").alias("rules_evaluated"), "sufficiency", "provenance_reason"))


def conflict_grid(spark, sf):
    return rs.conflict_rows(rs.assess(incident_grid(spark, sf)))


def outcome_grid(spark, sf):
    """How many windows end in each combination of outcomes."""
    a = rs.assess(incident_grid(spark, sf))
    return a.groupBy("provenance_reason", "sufficiency", "rule_fired", "final_decision", "severity").agg(F.count(F.lit(1)).alias("n"))


def guard_detection(spark, sf):
    """Citations of every TRAIN window that name an artifact; some texts name a label, some artifacts are others or missing."""
    w = base.event_windows(spark, sf, messages=True)
    train = w.filter(F.col("split") == "train")
    chunk = ret.chunk_id(F.col("dataset"), F.col("split"), F.col("window_id"), ret.template_text(F.col("template_ids")))
    s = train.select(F.col("window_id").alias("query_id"), "dataset", F.col("window_id").alias("source_window_id"), chunk.alias("chunk_id"), F.lit(1).alias("selected_rank"), F.lit(1.0).alias("retrieval_score"), F.lit(1.0).alias("selection_score"))
    c = prov.create_citations(s, w, ARTIFACT)
    case = F.substring("source_window_id", -1, 1)
    c = c.withColumn("citation_text", F.when(case == "6", F.concat("citation_text", F.lit(" is_anomaly"))).otherwise(F.col("citation_text")))
    c = c.withColumn("artifact_sha256", F.when(case == "7", F.sha2("citation_id", 256)).when(case != "8", F.col("artifact_sha256")))
    return prov.verify_citations(c, w, ARTIFACT).select("query_id", "status", "reason")


QUERIES = {f.__name__: f for f in (assessment_grid, conflict_grid, outcome_grid, guard_detection)}

_GRID = """
g0 AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM orders),
g1 AS (
  SELECT k, c, 'order_' || k AS window_id, k % 5 <> 0 AS esc, (c % 25) / 8.0::DOUBLE AS a, (k % 20) / 8.0::DOUBLE AS b0, k % 17 = 0 AS unk, k % 13 AS f,
    list_transform(range(1, CASE WHEN k % 13 = 5 THEN 1 ELSE c % 4 + 1 END), lambda i: ((k + 7 * i) % 9) / 8.0::DOUBLE) AS rel,
    list_transform(range(1, CASE WHEN k % 13 = 5 THEN 1 ELSE c % 4 + 1 END), lambda i: ((c + i) % 8) / 8.0::DOUBLE) AS gap FROM g0),
g2 AS (
  SELECT *, len(rel) AS n, coalesce(list_sum(rel) / len(rel), 0.0::DOUBLE) AS mr, coalesce(list_max(rel), 0.0::DOUBLE) AS xr, coalesce(list_sum(gap) / len(gap), 0.0::DOUBLE) AS red,
    CASE WHEN NOT esc THEN 'VERIFIED' WHEN f = 5 THEN 'no_bundle' WHEN f = 1 THEN 'dataset_mismatch' WHEN f = 2 THEN 'split_not_train' WHEN f = 0 THEN 'not_verified' WHEN f = 3 AND len(rel) > 0 THEN 'bad_source_hash'
      WHEN f = 4 AND len(rel) > 0 THEN 'citation_id_mismatch' ELSE 'VERIFIED' END AS why FROM g1),
g3 AS (SELECT *, why = 'VERIFIED' AS ok, CASE WHEN n > 1 THEN 1.0::DOUBLE - red WHEN n = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS div, (b0 >= 1.0::DOUBLE) = (a >= 0.5::DOUBLE) AS agree FROM g2),
g4 AS (
  SELECT *, CASE WHEN ok THEN len(list_filter(rel, lambda r: r >= 0.7::DOUBLE)) ELSE 0 END AS sup,
    CASE WHEN NOT esc THEN 'SUFFICIENT' WHEN NOT ok THEN 'INSUFFICIENT' WHEN n >= 2 AND mr >= 0.5::DOUBLE AND div >= 0.2::DOUBLE THEN 'SUFFICIENT' WHEN n >= 1 AND mr >= 0.4::DOUBLE THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS suff FROM g3),
g5 AS (SELECT *, esc AND a >= 1.2::DOUBLE AND sup = 0 AS c1, esc AND NOT agree AS c2, esc AND suff = 'INSUFFICIENT' AND n >= 2 AS c3, esc AND NOT ok AS c4 FROM g4),
g6 AS (
  SELECT *, CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) + CAST(c4 AS INTEGER) AS nc,
    round(greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN c1 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c4 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS agr,
    CASE WHEN esc AND NOT ok THEN 'RULE-PROV-001' WHEN NOT esc THEN 'RULE-NORM-001' WHEN suff = 'INSUFFICIENT' THEN 'RULE-SUFF-001' WHEN c1 THEN 'RULE-CONF-001' WHEN a >= 1.2::DOUBLE AND sup >= 1 AND suff = 'SUFFICIENT' THEN 'RULE-INC-001' ELSE 'RULE-SUSP-001' END AS rule FROM g5),
grid AS (
  SELECT *, CASE rule WHEN 'RULE-NORM-001' THEN 'NORMAL' WHEN 'RULE-SUFF-001' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'RULE-PROV-001' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'RULE-INC-001' THEN 'INCIDENT' ELSE 'SUSPICIOUS' END AS dec,
    CASE rule WHEN 'RULE-INC-001' THEN CASE WHEN unk OR a >= 2.5::DOUBLE THEN 'CRITICAL' WHEN xr >= 0.8::DOUBLE AND sup >= 2 THEN 'HIGH' ELSE 'MEDIUM' END
      WHEN 'RULE-CONF-001' THEN 'MEDIUM' WHEN 'RULE-SUSP-001' THEN CASE WHEN a >= 1.2::DOUBLE OR nc > 0 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS sev,
    CASE WHEN NOT ok THEN 0.05::DOUBLE WHEN NOT esc THEN 0.95::DOUBLE ELSE least(0.98::DOUBLE, greatest(0.05::DOUBLE, 0.3::DOUBLE * agr + 0.3::DOUBLE * mr + 0.2::DOUBLE * div + 0.2::DOUBLE - 0.25::DOUBLE * least(nc, 3) - CASE WHEN suff = 'INSUFFICIENT' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)) END AS conf,
    CASE rule WHEN 'RULE-NORM-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-NORM-001' WHEN 'RULE-PROV-001' THEN 'RULE-PROV-001' WHEN 'RULE-SUFF-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001'
      WHEN 'RULE-CONF-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001' WHEN 'RULE-INC-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001,RULE-INC-001'
      ELSE 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001,RULE-INC-001,RULE-SUSP-001' END AS tried FROM g6)"""

ORACLES = {
    "assessment_grid": sql(_GRID, """
SELECT window_id, dec AS final_decision, sev AS severity, round(conf, 6) AS confidence, agr AS agreement_score, CASE WHEN agr >= 0.8::DOUBLE THEN 'HIGH' WHEN agr >= 0.5::DOUBLE THEN 'MODERATE' WHEN agr >= 0.3::DOUBLE THEN 'LOW' ELSE 'CONFLICT' END AS agreement_level,
  rule AS rule_fired, tried AS rules_evaluated, suff AS sufficiency, why AS provenance_reason FROM grid"""),
    "conflict_grid": sql(_GRID, """
SELECT window_id, 'CONF-001' AS conflict_id, 'ANOMALY_EVIDENCE_MISMATCH' AS type, 'HIGH' AS severity FROM grid WHERE c1 UNION ALL SELECT window_id, 'CONF-002', 'CROSS_MODEL_DISAGREEMENT', 'MEDIUM' FROM grid WHERE c2
UNION ALL SELECT window_id, 'CONF-003', 'COUNT_RELEVANCE_DIVERGENCE', 'LOW' FROM grid WHERE c3 UNION ALL SELECT window_id, 'CONF-PROV', 'PROVENANCE_INTEGRITY_FAILURE', 'CRITICAL' FROM grid WHERE c4"""),
    "outcome_grid": sql(_GRID, "SELECT why AS provenance_reason, suff AS sufficiency, rule AS rule_fired, dec AS final_decision, sev AS severity, count(*) AS n FROM grid GROUP BY ALL"),
    "guard_detection": sql(WINDOWS, """
SELECT window_id AS query_id, CASE WHEN right(window_id, 1) IN ('6', '7', '8') THEN 'INVALID' ELSE 'VALID' END AS status,
  CASE right(window_id, 1) WHEN '6' THEN 'label_guard' WHEN '7' THEN 'artifact_mismatch' WHEN '8' THEN 'artifact_mismatch' ELSE 'ok' END AS reason FROM win WHERE split = 'train'"""),
}
