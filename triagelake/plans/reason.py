"""Queries over rule-based reasoning and the checking of written claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize
from triagelake.operators import claims as cl
from triagelake.operators import reasoning as rs
from triagelake.plans import evidence as evp
from triagelake.plans.base import rounded, sql
from triagelake.plans.evidence import CITED
from triagelake.sources import tables


def incidents(e: dict[str, DataFrame], bundles: DataFrame) -> DataFrame:
    """Gated windows in the shape the reasoning stage wants; a cleared window has no bundle."""
    b = bundles.select("dataset", F.col("query_id").alias("window_id"), "bundle_id", "citations", F.col("dataset").alias("bundle_dataset"), F.col("split").alias("bundle_split"), "all_verified")
    distinct = F.col("unique_templates") if "unique_templates" in e["gated"].columns else F.size(F.array_distinct("template_ids"))
    g = e["gated"].select(
        "dataset", "split", "window_id", "session_id", "record_count", distinct.alias("unique_templates"), "has_unknown_template",
        "start_time", "end_time", F.col("b2_score").alias("anomaly_score"), F.col("score").alias("b0_score"), "decision",
    )
    return g.join(b, ["dataset", "window_id"], "left")


def assessed(spark, sf_dir: str) -> DataFrame:
    e = evp.evidence(spark, sf_dir)
    return rs.assess(materialize(incidents(e, evp.bundles(e)), "incidents"))


def signals(spark, sf):
    a = assessed(spark, sf)
    names = [f.name for f in a.schema["signals"].dataType.fields]
    return rounded(a.select("window_id", *[F.col(f"signals.{n}.normalized").alias(n) for n in names]))


def contributions(spark, sf):
    return rounded(assessed(spark, sf).select("window_id", F.inline("contributions")))


def conflicts(spark, sf):
    return rs.conflict_rows(assessed(spark, sf))


def assessments(spark, sf):
    a = assessed(spark, sf)
    return rounded(a.select("window_id", "final_decision", "severity", "confidence", "agreement_score", "agreement_level", "rule_fired", F.array_join("rules_evaluated", ",").alias("rules_evaluated"), "sufficiency", "provenance_reason"))


def reasoning_summary(spark, sf):
    return rs.reasoning_summary(assessed(spark, sf))


def reasoning_averages(spark, sf):
    return rounded(rs.reasoning_averages(assessed(spark, sf)))


def ablation_modes(spark, sf):
    e = evp.evidence(spark, sf)
    a = rs.ablation_modes(materialize(incidents(e, evp.bundles(e)), "incidents"))
    return a.groupBy("mode", "final_decision").agg(F.count(F.lit(1)).alias("n"))


def assessment_fingerprints(spark, sf):
    a = assessed(spark, sf).select("window_id", "final_decision", "severity", "rule_fired", F.round("confidence", 6).alias("confidence"))
    return a.select("window_id", rs.row_fingerprint(a).alias("fingerprint"))


def explanation_rows(spark, sf_dir: str) -> DataFrame:
    """Every conversation turn as a written explanation of one claim.

    The opening turn of the conversation is its evidence. Odd turns state another decision, every
    fifth is no JSON, and the cited id is right, unknown or missing in turn.
    """
    c = tables.table(spark, sf_dir, "conversations")
    first = c.filter(F.col("turn") == 0).select("conv_id", F.col("text").alias("opening"))
    cid = F.concat(F.lit("cit_"), "conv_id")
    cited = F.when(F.col("turn") % 3 == 0, F.array(cid)).when(F.col("turn") % 3 == 1, F.array(F.lit("cit_unknown"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("role") == "user", F.lit("observation")).when(F.col("turn") % 4 == 1, F.lit("INTERPRETATION")).otherwise(F.lit("speculation"))
    body = F.struct(
        F.when(F.col("turn") % 2 == 0, F.lit("Insufficient_Evidence")).otherwise(F.lit("INCIDENT")).alias("incident_decision"), F.lit("LOW").alias("severity"),
        F.col("text").alias("summary"), F.array(F.struct(F.col("text").alias("text"), kind.alias("claim_type"), cited.alias("citation_ids"))).alias("claims"),
    )
    citation = F.struct(
        cid.alias("citation_id"), F.col("opening").alias("citation_text"), F.lit(1).alias("selected_rank"), F.lit(0.9).alias("retrieval_score"), F.lit(0.8).alias("selection_score"),
        F.struct(F.col("conv_id").alias("line_start"), (F.col("conv_id") + 5).alias("line_end"), F.lit(6).cast("long").alias("record_count")).alias("source_location"),
    )
    out = c.join(first, "conv_id").select(
        F.lit("conversations").alias("dataset"), F.lit("calibration").alias("split"), F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("window_id"),
        F.when(F.col("turn") % 5 == 4, F.concat(F.lit("no json: "), "text")).otherwise(F.to_json(body)).alias("raw_json"),
        F.array(citation).alias("citations"), F.lit(True).alias("all_verified"), F.lit("INSUFFICIENT_EVIDENCE").alias("final_decision"), F.lit("LOW").alias("severity"),
        F.lit(0.5).alias("confidence"), F.lit(True).alias("provenance_ok"), F.lit("VERIFIED").alias("provenance_reason"),
    )
    return out.withColumn("trusted", cl.trusted_numbers(F.col("confidence"), F.array(F.lit(0.25)), F.col("citations")))


def _faithful(spark, sf):
    return cl.check_faithfulness(cl.check_citations(cl.parse_claims(explanation_rows(spark, sf))))


def claims_parse(spark, sf):
    c = cl.explode_claims(cl.parse_claims(explanation_rows(spark, sf)))
    return rounded(c.select("window_id", "claim_id", F.sha2("text", 256).alias("text_hash"), "claim_type", "is_factual", F.size("citation_ids").alias("ids"), F.size("notes").alias("notes")))


def citation_check(spark, sf):
    c = cl.check_citations(cl.parse_claims(explanation_rows(spark, sf)))
    return rounded(c.select("window_id", "citation_status", "citation_precision", "valid_refs", "total_refs", F.array_join("unknown_ids", ",").alias("unknown_ids")))


def faithfulness(spark, sf):
    f = _faithful(spark, sf).filter(F.col("parsed").isNotNull())
    c = F.get("claims", F.lit(0))
    return rounded(f.select("window_id", "faithfulness_status", "citation_coverage", "grounding_score", "numeric_ok", "factual_claims", "supported_factual",
                            c["supported"].alias("supported"), c["problem"].alias("problem"), c["support_score"].alias("support_score")))


def validation(spark, sf):
    v = cl.validate(_faithful(spark, sf))
    return v.select("window_id", "is_valid", F.array_join("reasons", ",").alias("reasons"))


def explanations(spark, sf):
    x = cl.assemble(cl.validate(_faithful(spark, sf)))
    return x.select("window_id", "explanation_status", "abstained", "abstention_reason", "explanation_id")


def claim_metrics(spark, sf):
    return rounded(cl.explanation_metrics(cl.assemble(cl.validate(_faithful(spark, sf)))))


def claim_outcomes(spark, sf):
    return cl.explanation_outcomes(cl.assemble(cl.validate(_faithful(spark, sf))))


def prompt_rows(spark, sf):
    a = assessed(spark, sf)
    return cl.prompt_text(cl.build_context(a.filter("is_escalated"), max_lines=5, max_chars=400)).select("window_id", "prompt")


QUERIES = {
    f.__name__: f
    for f in (
        signals, contributions, conflicts, assessments, reasoning_summary, reasoning_averages, ablation_modes, assessment_fingerprints, claims_parse, citation_check, faithfulness,
        validation, explanations, claim_metrics, claim_outcomes, prompt_rows,
    )
}

ASSESS = CITED + """,
agg AS (SELECT query_id AS window_id, count(*) AS n, avg(retrieval_score) AS mr, max(retrieval_score) AS xr, avg(greatest(0.0::DOUBLE, retrieval_score - selection_score)) AS red,
  count(*) FILTER (WHERE retrieval_score >= 0.7::DOUBLE) AS sup FROM cit GROUP BY 1),
inc0 AS (
  SELECT g.window_id, decision = 'ESCALATE' AS esc, g.b2_score AS a, s.score AS b0, win.record_count AS rc, list_unique(win.template_ids) AS ut, win.end_time - win.start_time AS dur,
    coalesce(n, 0) AS n, coalesce(mr, 0.0::DOUBLE) AS mr, coalesce(xr, 0.0::DOUBLE) AS xr, coalesce(sup, 0) AS sup,
    CASE WHEN n > 1 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - red)) WHEN n = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS div
  FROM gated g JOIN win USING (window_id) JOIN scored0 s USING (window_id) LEFT JOIN agg USING (window_id)),
inc1 AS (
  SELECT *, (b0 >= 1.0::DOUBLE) = (a >= 0.5::DOUBLE) AS agree, {suff} AS suff, CASE WHEN dur > 0 THEN rc / greatest(dur, 1.0::DOUBLE) ELSE CAST(rc AS DOUBLE) END AS rate FROM {src}),
inc2 AS (
  SELECT *, esc AND a >= 1.2::DOUBLE AND sup = 0 AS c1, esc AND NOT agree AS c2, esc AND suff = 'INSUFFICIENT' AND n >= 2 AS c3 FROM inc1),
inc3 AS (SELECT *, {active} AS act, CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) AS nc FROM inc2),
inc4 AS (
  SELECT *, CASE WHEN act THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN c1 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))), 4) ELSE 1.0::DOUBLE END AS agr,
    CASE WHEN NOT esc THEN 'RULE-NORM-001' WHEN suff = 'INSUFFICIENT' THEN 'RULE-SUFF-001' WHEN act AND c1 THEN 'RULE-CONF-001' WHEN a >= 1.2::DOUBLE AND sup >= 1 AND suff = 'SUFFICIENT' THEN 'RULE-INC-001' ELSE 'RULE-SUSP-001' END AS rule
  FROM inc3),
ass AS (
  SELECT *, CASE rule WHEN 'RULE-NORM-001' THEN 'NORMAL' WHEN 'RULE-SUFF-001' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'RULE-INC-001' THEN 'INCIDENT' ELSE 'SUSPICIOUS' END AS dec,
    CASE rule WHEN 'RULE-INC-001' THEN CASE WHEN a >= 2.5::DOUBLE THEN 'CRITICAL' WHEN round(xr, 4) >= 0.8::DOUBLE AND sup >= 2 THEN 'HIGH' ELSE 'MEDIUM' END
      WHEN 'RULE-CONF-001' THEN 'MEDIUM' WHEN 'RULE-SUSP-001' THEN CASE WHEN a >= 1.2::DOUBLE OR (act AND nc > 0) THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS sev,
    CASE WHEN NOT esc THEN 0.95::DOUBLE ELSE least(0.98::DOUBLE, greatest(0.05::DOUBLE, 0.3::DOUBLE * agr + 0.3::DOUBLE * mr + 0.2::DOUBLE * div + 0.2::DOUBLE - CASE WHEN act THEN 0.25::DOUBLE * least(nc, 3) ELSE 0.0::DOUBLE END - CASE WHEN suff = 'INSUFFICIENT' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)) END AS conf,
    CASE rule WHEN 'RULE-NORM-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-NORM-001' WHEN 'RULE-SUFF-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001'
      WHEN 'RULE-CONF-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001' WHEN 'RULE-INC-001' THEN 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001,RULE-INC-001'
      ELSE 'RULE-PROV-001,RULE-INPUT-001,RULE-SUFF-001,RULE-CONF-001,RULE-INC-001,RULE-SUSP-001' END AS tried
  FROM inc4)"""

_SUFF = "CASE WHEN NOT esc THEN 'SUFFICIENT' WHEN n >= 2 AND mr >= 0.5::DOUBLE AND div >= 0.2::DOUBLE THEN 'SUFFICIENT' WHEN n >= 1 AND mr >= 0.4::DOUBLE THEN 'PARTIAL' ELSE 'INSUFFICIENT' END"
_FULL = ASSESS.format(suff=_SUFF, src="inc0", active="true")
_MODES = ASSESS.format(
    suff=f"CASE WHEN mode = 'relevance_only' THEN CASE WHEN NOT esc THEN 'SUFFICIENT' WHEN n >= 2 AND mr >= 0.5::DOUBLE THEN 'SUFFICIENT' WHEN n >= 1 AND mr >= 0.4::DOUBLE THEN 'PARTIAL' ELSE 'INSUFFICIENT' END "
    f"WHEN mode = 'sufficiency_disabled' AND esc AND n > 0 THEN 'SUFFICIENT' ELSE {_SUFF} END",
    src="inc0, (SELECT unnest(['full', 'relevance_only', 'sufficiency_disabled', 'conflict_ignored']) AS mode)", active="mode <> 'conflict_ignored'",
)

_STOP = ", ".join(f"'{w}'" for w in cl.STOPWORDS)


def _words(expr: str) -> str:
    # a word with an accented letter is no ASCII word, so it is blanked before the ASCII match
    plain = rf"regexp_replace(lower({expr}), '[\p{{L}}\p{{N}}_]*[à-öø-ÿßœ][\p{{L}}\p{{N}}_]*', 'é', 'g')"
    return rf"list_filter(list_distinct(regexp_extract_all({plain}, '\b[a-zA-Z0-9_-]{{3,}}\b')), lambda w: NOT list_contains([{_STOP}], w))"


def _any(words: tuple[str, ...]) -> str:
    return "list_has_any(words, [" + ", ".join(f"'{w}'" for w in words) + "])"


CLAIMS = rf"""
src AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS raw, regexp_replace(c.text, '^\s+|\s+$', '', 'g') AS text, f.text AS opening, 'conv_' || c.conv_id || '_' || c.turn AS window_id,
    c.turn % 5 <> 4 AS readable, CASE c.turn % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'unknown' ELSE 'none' END AS cite,
    CASE WHEN c.role = 'user' THEN 'OBSERVATION' ELSE 'INTERPRETATION' END AS claim_type, c.role = 'user' AS factual
  FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0),
tok AS (
  SELECT *, {_words('text')} AS words, {_words('opening')} AS src_words,
    list_filter(list_transform(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b'), lambda x: CAST(x AS DOUBLE)), lambda x:
      NOT list_contains(list_transform([0,1,2,3,4,5,6,7,8,9,10,100,0.25,0.5,0.8,0.9,conv_id,conv_id+5], lambda t: CAST(t AS DOUBLE)), round(x, 2))
      AND NOT list_contains(list_transform([0,1,2,3,4,5,6,7,8,9,10,100,0.25,0.5,0.8,0.9,conv_id,conv_id+5], lambda t: CAST(t AS DOUBLE)), round(x, 4))) AS bad
  FROM src),
ovl AS (SELECT *, CASE WHEN len(words) = 0 THEN 1.0::DOUBLE ELSE CASE WHEN cite = 'valid' THEN len(list_intersect(words, src_words)) ELSE 0 END / CAST(len(words) AS DOUBLE) END AS overlap FROM tok WHERE text <> ''),
chk AS (
  SELECT *, CASE WHEN factual THEN CASE WHEN cite = 'none' THEN 'no_citation' WHEN cite = 'unknown' THEN 'unknown_citation' WHEN overlap < 0.05::DOUBLE AND NOT {_any(cl.SIGNAL_WORDS)} THEN 'low_overlap' END
    WHEN cite = 'none' AND {_any(cl.EXTERNAL_FAULT_WORDS)} AND NOT {_any(cl.ASSESSMENT_WORDS)} THEN 'external_event' END AS problem,
    regexp_matches(text, '(?i)\b(confirmed incident|definite attack|verified failure|incident confirmed)\b') AS contra
  FROM ovl),
fth AS (
  SELECT *, CASE WHEN NOT factual THEN 1.0::DOUBLE WHEN problem IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov, len(bad) = 0 AS num,
    CASE WHEN factual AND cite <> 'valid' THEN 0.0::DOUBLE WHEN factual THEN round(overlap, 4) WHEN problem IS NOT NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM chk),
sts AS (SELECT *, CASE WHEN contra THEN 'INVALID' WHEN NOT factual THEN 'VERIFIED' WHEN cov >= 0.7::DOUBLE AND num THEN 'VERIFIED' WHEN cov > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM fth),
val AS (
  SELECT *, CASE WHEN NOT readable THEN ['json_parse'] ELSE list_filter([CASE WHEN turn % 2 = 1 THEN 'decision_immutability' END, CASE WHEN cite = 'unknown' THEN 'citation_validation' END, CASE WHEN NOT num THEN 'numeric_check' END,
    CASE WHEN contra THEN 'contradiction_check' END, CASE WHEN factual AND cov < 0.5::DOUBLE THEN 'coverage_check' END,
    CASE WHEN problem IS NOT NULL AND regexp_matches(lower(text), '\b({"|".join(cl.RISKY_PHRASES)})\b') THEN 'freeform_text_inspection' END], lambda r: r IS NOT NULL) END AS reasons
  FROM sts)"""

ORACLES = {
    "signals": sql(_FULL, """
SELECT window_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, a / 1.2::DOUBLE)), 6) AS anomaly_score_strength, CASE WHEN esc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS selective_escalation_state,
  CASE WHEN agree THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS baseline_agreement, least(1.0::DOUBLE, n / 2.0::DOUBLE) AS evidence_count, round(mr, 6) AS evidence_relevance, round(div, 6) AS evidence_diversity,
  round(1.0::DOUBLE - ut / CAST(rc AS DOUBLE), 6) AS repeated_template_behavior, 0.0::DOUBLE AS unknown_template_presence, round(least(1.0::DOUBLE, rate / 50.0::DOUBLE), 6) AS temporal_concentration,
  1.0::DOUBLE AS evidence_provenance_validity, CASE suff WHEN 'SUFFICIENT' THEN 1.0::DOUBLE WHEN 'PARTIAL' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS evidence_sufficiency FROM ass"""),
    "contributions": sql(CITED, """
SELECT query_id AS window_id, citation_id, chunk_id, round(retrieval_score, 4) AS relevance_score, round(greatest(0.0::DOUBLE, retrieval_score - selection_score), 4) AS redundancy_score,
  CASE WHEN retrieval_score >= 0.7::DOUBLE THEN 'SUPPORTING' WHEN retrieval_score >= 0.4::DOUBLE THEN 'CONTEXTUAL' ELSE 'CONTRADICTING' END AS contribution_type,
  CASE WHEN retrieval_score >= 0.85::DOUBLE THEN 'HIGH' WHEN retrieval_score >= 0.7::DOUBLE THEN 'MEDIUM' WHEN retrieval_score >= 0.4::DOUBLE AND retrieval_score - selection_score < 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS contribution_strength,
  'VERIFIED' AS provenance_status FROM cit"""),
    "conflicts": sql(_FULL, """
SELECT window_id, 'CONF-001' AS conflict_id, 'ANOMALY_EVIDENCE_MISMATCH' AS type, 'HIGH' AS severity FROM ass WHERE c1 UNION ALL SELECT window_id, 'CONF-002', 'CROSS_MODEL_DISAGREEMENT', 'MEDIUM' FROM ass WHERE c2
UNION ALL SELECT window_id, 'CONF-003', 'COUNT_RELEVANCE_DIVERGENCE', 'LOW' FROM ass WHERE c3"""),
    "assessments": sql(_FULL, """
SELECT window_id, dec AS final_decision, sev AS severity, round(conf, 6) AS confidence, agr AS agreement_score, CASE WHEN agr >= 0.8::DOUBLE THEN 'HIGH' WHEN agr >= 0.5::DOUBLE THEN 'MODERATE' WHEN agr >= 0.3::DOUBLE THEN 'LOW' ELSE 'CONFLICT' END AS agreement_level,
  rule AS rule_fired, tried AS rules_evaluated, suff AS sufficiency, 'VERIFIED' AS provenance_reason FROM ass"""),
    "assessment_fingerprints": sql(_FULL, """
SELECT window_id, sha256('{"confidence":' || CAST(round(conf, 6) AS VARCHAR) || ',"final_decision":"' || dec || '","rule_fired":"' || rule || '","severity":"' || sev || '","window_id":"' || window_id || '"}') AS fingerprint FROM ass"""),
    "reasoning_summary": sql(_FULL, """
SELECT 'decision' AS measure, dec AS key, count(*) AS n FROM ass GROUP BY 2 UNION ALL SELECT 'severity', sev, count(*) FROM ass GROUP BY 2 UNION ALL SELECT 'sufficiency', suff, count(*) FROM ass GROUP BY 2
UNION ALL SELECT 'provenance', 'VERIFIED', count(*) FROM ass UNION ALL SELECT 'rule', rule, count(*) FROM ass GROUP BY 2
UNION ALL SELECT 'conflict', c, count(*) FROM (SELECT 'CONF-001' AS c FROM ass WHERE c1 UNION ALL SELECT 'CONF-002' FROM ass WHERE c2 UNION ALL SELECT 'CONF-003' FROM ass WHERE c3) GROUP BY 2"""),
    "reasoning_averages": sql(_FULL, """
SELECT count(*) AS total_assessed, CAST(sum(nc) AS BIGINT) AS conflict_count, round(avg(CASE WHEN nc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS conflict_rate, round(avg(n), 4) AS average_evidence_count,
  round(avg(round(mr, 4)), 4) AS average_evidence_relevance, round(avg(conf), 4) AS average_confidence FROM ass"""),
    "ablation_modes": sql(_MODES, "SELECT mode, dec AS final_decision, count(*) AS n FROM ass GROUP BY ALL"),
    "claims_parse": sql(CLAIMS, r"""
SELECT window_id, 'CLM-' || window_id || '-001' AS claim_id, sha256(text) AS text_hash, claim_type, factual AS is_factual, CAST(CASE WHEN cite = 'none' THEN 0 ELSE 1 END AS BIGINT) AS ids,
  CAST(regexp_matches(text, '(?i)\bcaused by\b') AS BIGINT) + CAST(regexp_matches(text, '(?i)\bcrashed because\b') AS BIGINT) + CAST(regexp_matches(text, '(?i)\bunderlying root cause is\b') AS BIGINT)
  + CAST(regexp_matches(text, '(?i)\bdefinitively caused\b') AS BIGINT) + CAST(regexp_matches(text, '(?i)\bfailure is due to\b') AS BIGINT) AS notes FROM src WHERE readable AND text <> ''"""),
    "citation_check": sql(CLAIMS, """
SELECT window_id, CASE WHEN r AND cite = 'unknown' THEN 'INVALID' ELSE 'VALID' END AS citation_status, CASE WHEN r AND cite = 'unknown' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS citation_precision,
  CAST(CASE WHEN r AND cite = 'valid' THEN 1 ELSE 0 END AS BIGINT) AS valid_refs, CAST(CASE WHEN r AND cite <> 'none' THEN 1 ELSE 0 END AS BIGINT) AS total_refs, CASE WHEN r AND cite = 'unknown' THEN 'cit_unknown' ELSE '' END AS unknown_ids
FROM (SELECT *, readable AND text <> '' AS r FROM src)"""),
    "faithfulness": sql(CLAIMS, """
SELECT window_id, status AS faithfulness_status, cov AS citation_coverage, round((cov + CASE WHEN num THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2, 4) AS grounding_score, num AS numeric_ok, CAST(factual AS BIGINT) AS factual_claims,
  CAST(factual AND problem IS NULL AS BIGINT) AS supported_factual, problem IS NULL AS supported, problem, score AS support_score FROM sts WHERE readable"""),
    "validation": sql(CLAIMS, "SELECT window_id, len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reasons FROM val"),
    "explanations": sql(CLAIMS, """
SELECT window_id, CASE WHEN len(reasons) = 0 THEN 'GENERATED' ELSE 'VALIDATION_FAILED' END AS explanation_status, len(reasons) > 0 AS abstained, CASE WHEN len(reasons) > 0 THEN 'validation: ' || array_to_string(reasons, '; ') END AS abstention_reason,
  CASE WHEN len(reasons) > 0 THEN 'EXP-' || window_id || '-ABSTAINED' ELSE 'EXP-' || left(sha256(window_id || ':conversations:calibration:none:1'), 16) END AS explanation_id FROM val"""),
    "claim_outcomes": sql(CLAIMS, """
SELECT 'status' AS measure, CASE WHEN len(reasons) = 0 THEN 'GENERATED' ELSE 'VALIDATION_FAILED' END AS key, count(*) AS n FROM val GROUP BY 2
UNION ALL SELECT 'faithfulness', CASE WHEN readable THEN status ELSE 'INVALID' END, count(*) FROM val GROUP BY 2"""),
    "claim_metrics": sql(CLAIMS, """
, u AS (SELECT *, len(reasons) = 0 AS good FROM val)
SELECT count(*) AS total_attempted, count(*) FILTER (WHERE good) AS successful, count(*) FILTER (WHERE NOT good) AS abstentions, count(*) FILTER (WHERE NOT good) AS validation_failures,
  count(*) FILTER (WHERE list_contains(reasons, 'decision_immutability')) AS decision_failures, count(*) FILTER (WHERE good) AS total_claims, count(*) FILTER (WHERE good AND factual) AS factual_claims,
  count(*) FILTER (WHERE good AND factual AND problem IS NULL) AS supported_factual_claims, count(*) FILTER (WHERE good AND cite = 'valid') AS valid_refs, count(*) FILTER (WHERE good AND cite <> 'none') AS total_refs,
  round(CASE WHEN count(*) FILTER (WHERE good AND factual) > 0 THEN count(*) FILTER (WHERE good AND factual AND problem IS NULL) / CAST(count(*) FILTER (WHERE good AND factual) AS DOUBLE) ELSE 1.0::DOUBLE END, 4) AS citation_coverage,
  round(CASE WHEN count(*) FILTER (WHERE good AND cite <> 'none') > 0 THEN count(*) FILTER (WHERE good AND cite = 'valid') / CAST(count(*) FILTER (WHERE good AND cite <> 'none') AS DOUBLE) ELSE 1.0::DOUBLE END, 4) AS citation_precision FROM u"""),
}
