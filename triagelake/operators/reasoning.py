"""Rule-based reasoning over escalated windows: signals, conflicts, decision, severity, confidence.

Input rows, one per window: dataset, split, window_id, record_count, unique_templates,
has_unknown_template, start_time, end_time, anomaly_score, b0_score, decision (the gate's), and the
bundle columns citations (bounded array), bundle_dataset, bundle_split, all_verified.
Everything is a column expression, so a whole table is assessed in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import at_most
from triagelake.operators.provenance import citation_id

# fixed values: thresholds of the signals, contributions, severity and confidence
ANOMALY_HIGH, ANOMALY_MEDIUM = 1.20, 0.50
RELEVANCE_HIGH, RELEVANCE_MEDIUM = 0.70, 0.40
DIVERSITY_HIGH, MIN_DIVERSITY, MIN_MEAN_RELEVANCE = 0.30, 0.20, 0.50
MIN_EVIDENCE, SUFFICIENT_EVIDENCE = 1, 2
SUPPORTING, CONTEXTUAL, MAX_REDUNDANCY = 0.70, 0.40, 0.60
CRITICAL_ANOMALY, SEVERITY_RELEVANCE = 2.50, 0.80
WEIGHTS = {"agreement": 0.30, "relevance": 0.30, "diversity": 0.20, "provenance": 0.20}
CONFLICT_PENALTY, INSUFFICIENT_PENALTY = 0.25, 0.40

MODES = ("full", "relevance_only", "sufficiency_disabled", "conflict_ignored")

# fixed values: the rule catalogue (id, priority, decision)
RULES = (
    ("RULE-PROV-001", 1, "INSUFFICIENT_EVIDENCE"),
    ("RULE-INPUT-001", 2, "INVALID_INPUT"),
    ("RULE-SUFF-001", 3, "INSUFFICIENT_EVIDENCE"),
    ("RULE-CONF-001", 4, "SUSPICIOUS"),
    ("RULE-INC-001", 5, "INCIDENT"),
    ("RULE-SUSP-001", 6, "SUSPICIOUS"),
    ("RULE-NORM-001", 7, "NORMAL"),
)


def _level(value: Column, high: float, medium: float | None = None) -> Column:
    out = F.when(value >= high, "HIGH")
    return (out if medium is None else out.when(value >= medium, "MEDIUM")).otherwise("LOW")


def _mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)).otherwise(F.lit(0.0))


def provenance_gate(df: DataFrame) -> DataFrame:
    """Add ``provenance_reason`` and ``provenance_ok``; only escalated windows need a bundle."""

    def good_hash(h: Column) -> Column:
        return F.coalesce(F.length(h) == 64, F.lit(False))

    def fresh_id(c: Column) -> Column:
        loc = c["source_location"]
        return c["citation_id"] == citation_id(F.col("bundle_dataset"), F.col("bundle_split"), c["chunk_id"], c["source_window_id"], loc["line_start"], loc["line_end"])

    reason = (
        F.when(F.upper(F.trim("decision")) != "ESCALATE", "VERIFIED")
        .when(F.col("citations").isNull(), "no_bundle")
        .when(F.lower(F.trim("bundle_dataset")) != F.lower(F.trim("dataset")), "dataset_mismatch")
        .when(F.lower(F.trim("bundle_split")) != "train", "split_not_train")
        .when(~F.col("all_verified"), "not_verified")
        .when(~F.forall("citations", lambda c: good_hash(c["citation_id"])), "bad_citation_id")
        .when(~F.forall("citations", lambda c: good_hash(c["source_content_hash"])), "bad_source_hash")
        .when(~F.forall("citations", lambda c: good_hash(c["template_content_hash"])), "bad_template_hash")
        .when(~F.forall("citations", fresh_id), "citation_id_mismatch")
        .otherwise("VERIFIED")
    )
    return df.withColumn("provenance_reason", reason).withColumn("provenance_ok", F.col("provenance_reason") == "VERIFIED")


def extract_signals(df: DataFrame) -> DataFrame:
    """Add the eleven signals as typed columns ``sig_*`` (value, normalized, strength)."""
    df = df.withColumn("is_escalated", F.upper(F.trim("decision")) == "ESCALATE")
    empty = F.array().cast(df.schema["citations"].dataType)
    df = df.withColumn("citations", F.coalesce("citations", empty)).withColumn("evidence_count", F.size("citations"))
    gap = F.transform("citations", lambda c: F.greatest(F.lit(0.0), c["retrieval_score"] - c["selection_score"]))
    df = (
        df.withColumn("mean_relevance", _mean(F.col("citations.retrieval_score")))
        .withColumn("max_relevance", F.coalesce(F.array_max("citations.retrieval_score"), F.lit(0.0)))
        .withColumn("diversity", F.when(F.col("evidence_count") > 1, at_most(1.0 - _mean(gap), 0.0, 1.0)).when(F.col("evidence_count") == 1, 0.5).otherwise(0.0))
        .withColumn("repeat_ratio", F.when(F.col("record_count") > 0, 1.0 - F.col("unique_templates") / F.col("record_count")).otherwise(0.0))
        .withColumn("duration", F.greatest(F.lit(0.0), F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0.0))))
        .withColumn("rate", F.when(F.col("duration") > 0, F.col("record_count") / F.greatest("duration", F.lit(1.0))).otherwise(F.col("record_count").cast("double")))
        .withColumn("models_agree", F.when(F.col("b0_score").isNotNull(), (F.col("b0_score") >= 1.0) == (F.col("anomaly_score") >= ANOMALY_MEDIUM)))
    )
    ok = F.col("provenance_ok")
    enough = (F.col("evidence_count") >= SUFFICIENT_EVIDENCE) & (F.col("mean_relevance") >= MIN_MEAN_RELEVANCE)
    some = (F.col("evidence_count") >= MIN_EVIDENCE) & (F.col("mean_relevance") >= RELEVANCE_MEDIUM)

    def sufficiency(good: Column) -> Column:
        return F.when(~F.col("is_escalated"), "SUFFICIENT").when(~ok, "INSUFFICIENT").when(good, "SUFFICIENT").when(some, "PARTIAL").otherwise("INSUFFICIENT")

    normal = sufficiency(enough & (F.col("diversity") >= MIN_DIVERSITY))
    if "mode" in df.columns:
        forced = F.when(F.col("is_escalated") & ok & (F.col("evidence_count") > 0), "SUFFICIENT").otherwise(normal)
        normal = F.when(F.col("mode") == "relevance_only", sufficiency(enough)).when(F.col("mode") == "sufficiency_disabled", forced).otherwise(normal)
    df = df.withColumn("sufficiency", normal)

    def signal(value: Column, normalized: Column, strength: Column) -> Column:
        return F.struct(value.alias("value"), normalized.cast("double").alias("normalized"), strength.alias("strength"))

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    suff = F.col("sufficiency")
    n = F.col("evidence_count")
    signals = {
        "anomaly_score_strength": signal(F.col("anomaly_score"), at_most(F.col("anomaly_score") / ANOMALY_HIGH, 0.0, 1.0), _level(F.col("anomaly_score"), ANOMALY_HIGH, ANOMALY_MEDIUM)),
        "selective_escalation_state": signal(F.upper("decision"), flag(F.col("is_escalated")), F.when(F.col("is_escalated"), "HIGH").otherwise("LOW")),
        "baseline_agreement": signal(F.col("models_agree"), F.coalesce(flag(F.col("models_agree")) + F.when(F.col("models_agree").isNull(), 0.5).otherwise(0.0), F.lit(0.5)), F.when(F.col("models_agree").isNull(), "MEDIUM").when(F.col("models_agree"), "HIGH").otherwise("LOW")),
        "evidence_count": signal(n, at_most(n / F.lit(float(SUFFICIENT_EVIDENCE)), 0.0, 1.0), F.when(n >= SUFFICIENT_EVIDENCE, "HIGH").when(n > 0, "MEDIUM").otherwise("LOW")),
        "evidence_relevance": signal(F.struct(F.round("mean_relevance", 4).alias("mean"), F.round("max_relevance", 4).alias("max")), at_most(F.col("mean_relevance"), 0.0, 1.0), F.when(n > 0, _level(F.col("mean_relevance"), RELEVANCE_HIGH, RELEVANCE_MEDIUM)).otherwise("LOW")),
        "evidence_diversity": signal(F.round("diversity", 4), F.col("diversity"), _level(F.col("diversity"), DIVERSITY_HIGH)),
        "repeated_template_behavior": signal(F.round("repeat_ratio", 4), F.col("repeat_ratio"), _level(F.col("repeat_ratio"), 0.80, 0.40)),
        "unknown_template_presence": signal(F.col("has_unknown_template"), flag(F.col("has_unknown_template")), F.when(F.col("has_unknown_template"), "HIGH").otherwise("LOW")),
        "temporal_concentration": signal(F.struct(F.round("duration", 2).alias("duration_sec"), F.round("rate", 4).alias("rate_per_sec")), at_most(F.col("rate") / 50.0, 0.0, 1.0), _level(F.col("rate"), 10.0)),
        "evidence_provenance_validity": signal(ok, flag(ok), F.when(ok, "HIGH").otherwise("LOW")),
        "evidence_sufficiency": signal(suff, F.when(suff == "SUFFICIENT", 1.0).when(suff == "PARTIAL", 0.5).otherwise(0.0), F.when(suff == "SUFFICIENT", "HIGH").when(suff == "PARTIAL", "MEDIUM").otherwise("LOW")),
    }
    return df.withColumn("signals", F.struct(*[c.alias(name) for name, c in signals.items()]))


def contribution(c: Column, ok: Column) -> Column:
    """Role of one citation in the assessment."""
    rel = c["retrieval_score"]
    redundancy = F.greatest(F.lit(0.0), rel - c["selection_score"])
    kind = F.when(~ok, "INSUFFICIENT").when(rel >= SUPPORTING, "SUPPORTING").when(rel >= CONTEXTUAL, "CONTEXTUAL").otherwise("CONTRADICTING")
    strength = (
        F.when(~ok, "LOW")
        .when(rel >= 0.85, "HIGH")
        .when(rel >= SUPPORTING, "MEDIUM")
        .when(rel >= CONTEXTUAL, F.when(redundancy < MAX_REDUNDANCY, "MEDIUM").otherwise("LOW"))
        .otherwise("LOW")
    )
    return F.struct(
        c["citation_id"].alias("citation_id"), c["chunk_id"].alias("chunk_id"), F.round(rel, 4).alias("relevance_score"), F.round(redundancy, 4).alias("redundancy_score"),
        kind.alias("contribution_type"), strength.alias("contribution_strength"), F.when(ok, "VERIFIED").otherwise("INVALID").alias("provenance_status"),
    )


def detect_conflicts(df: DataFrame) -> DataFrame:
    """Add ``contributions``, ``supporting_count`` and ``conflicts`` (id, type, severity)."""
    df = df.withColumn("contributions", F.transform("citations", lambda c: contribution(c, F.col("provenance_ok"))))
    df = df.withColumn("supporting_count", F.size(F.filter("contributions", lambda c: c["contribution_type"] == "SUPPORTING")))

    def conflict(cond: Column, cid: str, kind: str, severity: str) -> Column:
        return F.when(F.col("is_escalated") & cond, F.struct(F.lit(cid).alias("conflict_id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity")))

    found = F.array(
        conflict((F.col("anomaly_score") >= ANOMALY_HIGH) & (F.col("supporting_count") == 0), "CONF-001", "ANOMALY_EVIDENCE_MISMATCH", "HIGH"),
        conflict(~F.coalesce("models_agree", F.lit(True)), "CONF-002", "CROSS_MODEL_DISAGREEMENT", "MEDIUM"),
        conflict((F.col("sufficiency") == "INSUFFICIENT") & (F.col("evidence_count") >= 2), "CONF-003", "COUNT_RELEVANCE_DIVERGENCE", "LOW"),
        conflict(~F.col("provenance_ok"), "CONF-PROV", "PROVENANCE_INTEGRITY_FAILURE", "CRITICAL"),
    )
    return df.withColumn("conflicts", F.array_compact(found))


def decide(df: DataFrame) -> DataFrame:
    """Add agreement, decision with its rule trace, severity and confidence."""
    active = F.col("conflicts")
    if "mode" in df.columns:
        active = F.when(F.col("mode") == "conflict_ignored", F.slice("conflicts", 1, 0)).otherwise(active)
    df = df.withColumn("active_conflicts", active)
    cost = F.aggregate("active_conflicts", F.lit(0.0), lambda a, c: a + F.when(c["severity"] == "HIGH", 0.4).when(c["severity"] == "MEDIUM", 0.2).otherwise(0.1))
    df = df.withColumn("agreement_score", F.round(at_most(1.0 - cost, 0.0, 1.0), 4))
    score = F.col("agreement_score")
    df = df.withColumn("agreement_level", F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MODERATE").when(score >= 0.3, "LOW").otherwise("CONFLICT"))

    esc, ok, suff = F.col("is_escalated"), F.col("provenance_ok"), F.col("sufficiency")
    severe = F.exists("active_conflicts", lambda c: c["severity"] == "HIGH")
    strong = (F.col("anomaly_score") >= ANOMALY_HIGH) & (F.col("supporting_count") >= 1) & (suff == "SUFFICIENT")
    rule = (
        F.when(esc & ~ok, "RULE-PROV-001").when(~esc, "RULE-NORM-001").when(suff == "INSUFFICIENT", "RULE-SUFF-001")
        .when(severe, "RULE-CONF-001").when(strong, "RULE-INC-001").otherwise("RULE-SUSP-001")
    )
    df = df.withColumn("rule_fired", rule)
    verdict, tried = None, None
    order = ["RULE-PROV-001", "RULE-INPUT-001", "RULE-SUFF-001", "RULE-CONF-001", "RULE-INC-001", "RULE-SUSP-001"]
    for rid, _, outcome in RULES:
        hit = F.col("rule_fired") == rid
        seen = ["RULE-PROV-001", "RULE-INPUT-001", "RULE-NORM-001"] if rid == "RULE-NORM-001" else order[: order.index(rid) + 1]
        trace = F.array(*[F.lit(r) for r in seen])
        verdict = F.when(hit, outcome) if verdict is None else verdict.when(hit, outcome)
        tried = F.when(hit, trace) if tried is None else tried.when(hit, trace)
    df = df.withColumn("final_decision", verdict).withColumn("rules_evaluated", tried)

    incident = (
        F.when(F.col("has_unknown_template") | (F.col("anomaly_score") >= CRITICAL_ANOMALY), "CRITICAL")
        .when((F.round("max_relevance", 4) >= SEVERITY_RELEVANCE) & (F.col("supporting_count") >= 2), "HIGH")
        .otherwise("MEDIUM")
    )
    suspicious = F.when((F.col("anomaly_score") >= ANOMALY_HIGH) | (F.size("active_conflicts") > 0), "MEDIUM").otherwise("LOW")
    df = df.withColumn("severity", F.when(F.col("final_decision") == "INCIDENT", incident).when(F.col("final_decision") == "SUSPICIOUS", suspicious).otherwise("LOW"))

    total = sum(WEIGHTS.values())
    raw = (
        WEIGHTS["agreement"] / total * score + WEIGHTS["relevance"] / total * at_most(F.col("mean_relevance"), 0.0, 1.0)
        + WEIGHTS["diversity"] / total * F.col("diversity") + F.lit(WEIGHTS["provenance"] / total)
        - CONFLICT_PENALTY * F.least(F.size("active_conflicts"), F.lit(3)) - F.when(suff == "INSUFFICIENT", INSUFFICIENT_PENALTY).otherwise(0.0)
    )
    return df.withColumn("confidence", F.when(~ok, 0.05).when(~esc, 0.95).otherwise(at_most(raw, 0.05, 0.98)))


def assess(incidents: DataFrame) -> DataFrame:
    """All of the above in one pass; with a ``mode`` column, each row follows its ablation mode."""
    return decide(detect_conflicts(extract_signals(provenance_gate(incidents))))


def conflict_rows(assessed: DataFrame) -> DataFrame:
    """One row per conflict of a window.

    Windows without one are left out after the arrays are opened: a filter on the array's size would be pushed
    below every step of the assessment, with all of their expressions in it.
    """
    return assessed.select("window_id", F.inline_outer("conflicts")).filter(F.col("conflict_id").isNotNull())


def ablation_modes(incidents: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Assess every window once per mode (a fixed handful)."""
    return assess(incidents.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))))


def reasoning_summary(assessed: DataFrame) -> DataFrame:
    """Long table (measure, key, n) of all distributions, one pass over the assessments."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("string").alias("key")) for m, c in (
            ("decision", "final_decision"), ("severity", "severity"), ("sufficiency", "sufficiency"), ("provenance", "provenance_reason"), ("rule", "rule_fired"))]),
        F.transform("conflicts", lambda c: F.struct(F.lit("conflict").alias("measure"), c["conflict_id"].alias("key"))),
    )
    return assessed.select(F.inline(pairs)).groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))


def reasoning_averages(assessed: DataFrame) -> DataFrame:
    """One row: how many windows, conflicts, share of windows with one, and averages; 0 of no window."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return assessed.agg(
        F.count(F.lit(1)).alias("total_assessed"),
        F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("conflict_count"),
        mean((F.size("conflicts") > 0).cast("double")).alias("conflict_rate"),
        mean(F.col("evidence_count").cast("double")).alias("average_evidence_count"),
        mean(F.round("mean_relevance", 4)).alias("average_evidence_relevance"),
        mean(F.col("confidence")).alias("average_confidence"),
    )


def row_fingerprint(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    """SHA-256 of a row's content in sorted column order, to compare two runs row by row."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in skip])), 256)
