"""Drift, reviews, audit tables and service metrics as aggregates over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import sha
from triagelake.operators.calibration import QUANTILES, quantiles, threshold_map
from triagelake.operators.parse import session_key

# fixed values: drift limits
MINIMUM_SAMPLES = 20
PSI_WATCH, PSI_DRIFT = 0.10, 0.25
RATE_WATCH, RATE_DRIFT = 0.05, 0.15
PSI_EPSILON = 1e-4

# fixed values: what a reviewer may decide
HUMAN_DECISIONS = ("CONFIRM", "REJECT", "NEEDS_REVIEW")

# fixed values: labels a metric may carry
ALLOWED_LABELS = ("dataset", "status", "endpoint", "decision", "severity", "stage", "provider", "model", "http_status_family")


# ---- drift ------------------------------------------------------------------------------------


def psi_edges(reference: DataFrame, bins: int = 10, score: str = "score") -> list[float]:
    """Inner bin edges: distinct reference quantiles, or an even grid if they are too few."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    row = quantiles(reference, names, score=score).first()
    edges = sorted({row[n] for n in names})
    if len(edges) < 3:
        lo, hi = edges[0], edges[-1] + 1e-5
        edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    return edges[1:-1]


def _bin_counts(df: DataFrame, edges: Sequence[float], score: str) -> DataFrame:
    """Counts of all bins in one row; there are at most ``bins`` of them."""
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(score)))
    return df.select(at.alias("b")).agg(F.array(*[F.count_if(F.col("b") == i) for i in range(len(edges) + 1)]).alias("n"))


def psi_bins(reference: DataFrame, current: DataFrame, bins: int = 10, score: str = "score") -> DataFrame:
    """Per-bin counts, shares and contribution to the population stability index."""
    edges = psi_edges(reference, bins, score)
    ref, cur = _bin_counts(reference, edges, score), _bin_counts(current, edges, score)
    k = len(edges) + 1
    pairs = ref.select(F.col("n").alias("r")).withColumn("c", cur.select("n").scalar())
    rows = pairs.select(
        F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x).alias("rt"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("ct"),
        F.posexplode(F.arrays_zip("r", "c")).alias("bin_index", "z"),
    )
    e = F.lit(PSI_EPSILON)
    rp, cp = (F.col("z.r") + e) / (F.col("rt") + e * k), (F.col("z.c") + e) / (F.col("ct") + e * k)
    return rows.select("bin_index", F.col("z.r").alias("reference_count"), F.col("z.c").alias("current_count"), rp.alias("reference_share"), cp.alias("current_share"), ((cp - rp) * F.log(cp / rp)).alias("contribution"))


def drift_reference(scores: DataFrame, alpha: float = 0.05, score: str = "score") -> dict[str, float]:
    """Threshold and escalation rate of a reference score table."""
    t = threshold_map(scores, [alpha], score)[alpha]
    return {"threshold": t, "escalation_rate": scores.agg(F.avg((F.col(score) > t).cast("double"))).first()[0]}


def drift_verdict(reference: DataFrame, current: DataFrame, alpha: float = 0.05, score: str = "score") -> DataFrame:
    """One row: shifts of moments and quantiles, escalation delta, PSI and the verdict."""
    base = drift_reference(reference, alpha, score)
    psi = psi_bins(reference, current, score=score).agg(F.sum("contribution")).scalar()

    def side(df: DataFrame, p: str) -> DataFrame:
        m = df.agg(F.count(F.lit(1)).alias(f"{p}_n"), F.avg(score).alias(f"{p}_mean"), F.stddev_pop(score).alias(f"{p}_std"), F.avg((F.col(score) > base["threshold"]).cast("double")).alias(f"{p}_rate"))
        q = quantiles(df, QUANTILES, score=score).select(F.struct(*QUANTILES)).scalar()
        return m.withColumn("_q", q).select(*m.columns, *[F.col(f"_q.{n}").alias(f"{p}_{n}") for n in QUANTILES])

    ref, cur = side(reference, "ref"), side(current, "cur")
    out = cur.withColumn("_r", ref.select(F.struct("*")).scalar()).select(*cur.columns, "_r.*").withColumn("psi", psi)
    delta = F.col("cur_rate") - F.lit(base["escalation_rate"])
    out = out.withColumn("escalation_rate_delta", delta)
    size = F.abs("escalation_rate_delta")
    status = (
        F.when(F.col("cur_n") < MINIMUM_SAMPLES, "INSUFFICIENT DATA").when((F.col("psi") >= PSI_DRIFT) | (size > RATE_DRIFT), "DRIFT DETECTED")
        .when((F.col("psi") >= PSI_WATCH) | (size > RATE_WATCH), "WATCH").otherwise("STABLE")
    )
    shifts = [F.round(F.col(f"cur_{n}") - F.col(f"ref_{n}"), 4).alias(f"{n}_shift") for n in QUANTILES]
    return out.withColumn("drift_status", status).select(
        "drift_status", F.col("drift_status").isin("DRIFT DETECTED", "WATCH").alias("review_required"), F.col("cur_n").alias("sample_size"), F.col("ref_n").alias("reference_sample_size"),
        F.round("psi", 4).alias("psi"), F.lit(base["threshold"]).alias("threshold"), F.round("cur_rate", 4).alias("current_escalation_rate"), F.round("escalation_rate_delta", 4).alias("escalation_rate_delta"),
        F.round(F.col("cur_mean") - F.col("ref_mean"), 4).alias("mean_shift"), F.round(F.col("cur_p50") - F.col("ref_p50"), 4).alias("median_shift"), F.round(F.col("cur_std") - F.col("ref_std"), 4).alias("std_shift"), *shifts,
    )


def density_histogram(df: DataFrame, low: float = 0.0, high: float = 3.5, bins: int = 14, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Density per bin over values in [low, high]; the last bin is closed. Empty bins have rows."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(score) - low) / width), F.lit(bins - 1)).cast("int")
    inside = df.filter((F.col(score) >= low) & (F.col(score) <= high)).select(*by, at.alias("b"))
    counts = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("t"), F.array(*[F.count_if(F.col("b") == i) for i in range(bins)]).alias("n"))
    rows = counts.select(*by, "t", F.posexplode("n").alias("bin", "c"))
    return rows.select(*by, "bin", (F.lit(low) + F.col("bin") * width).alias("low"), F.col("c").alias("count"), (F.col("c") / (F.col("t") * width)).alias("density"))


# ---- reviews ----------------------------------------------------------------------------------


def latest_reviews(reviews: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last record per (incident, reviewer); rows with an unknown human decision are refused."""
    keys = ["incident_id", "reviewer_id"]
    rest = [c for c in reviews.columns if c not in keys]
    valid = reviews.filter(F.col("human_decision").isin(*HUMAN_DECISIONS))
    last = valid.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    agreed = F.when(F.col("human_decision") == "CONFIRM", F.lit("Agreed with machine triage"))
    return last.select(*keys, "_r.*").withColumn("reason", F.coalesce("reason", agreed))


def review_summary(latest: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return latest.agg(
        n.alias("total_reviews"), *[F.count_if(F.col("human_decision") == d).alias(f"{d.lower()}_count") for d in HUMAN_DECISIONS],
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("human_decision") == "CONFIRM"), n), 4), F.lit(1.0)).alias("human_agreement_rate"),
    )


def review_reasons(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- graph, passports, replay -----------------------------------------------------------------


def _short(*parts: Column) -> Column:
    return F.substring(sha(*parts), 1, 16)


def evidence_graph(assessed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every window's decision path, from recorded data only.

    A cleared window ends at its decision. All nodes and edges of a window come from its own row.
    """
    iid = F.col("window_id")

    def node(kind: str, key: Column, label: Column, status: Column, digest: Column) -> Column:
        return F.struct(F.concat(F.lit(f"node:{kind}:"), key).alias("id"), F.lit(kind).alias("type"), label.alias("label"), status.alias("status"), digest.alias("hash"))

    def edge(a: str, b: str, label: str, akey: Column = iid, bkey: Column = iid) -> Column:
        return F.struct(F.concat(F.lit(f"node:{a}:"), akey).alias("source"), F.concat(F.lit(f"node:{b}:"), bkey).alias("target"), F.lit(label).alias("label"))

    esc = F.col("is_escalated")
    score = F.format_string("%.6f", "anomaly_score")
    head = F.array(
        node("incident", iid, F.concat(F.lit("Incident "), iid), F.lit("ACTIVE"), _short(F.lit("incident"), iid)),
        node("window", iid, F.concat(F.lit("Window "), iid), F.lit("PARSED"), _short(iid)),
        node("score", iid, F.concat(F.lit("Score: "), F.format_string("%.3f", "anomaly_score")), F.lit("COMPUTED"), _short(F.lit("score"), score)),
        node("decision", iid, F.concat(F.lit("Decision: "), "decision"), F.when(esc, "ESCALATED").otherwise("CLEARED"), _short(F.lit("decision"), F.col("decision"), F.format_string("%.6f", F.lit(threshold)))),
    )
    verified = F.when(F.col("provenance_ok"), "VERIFIED").otherwise("UNRESOLVED")
    body = F.array(
        node("retrieval", iid, F.lit("Retrieval (train)"), F.lit("INDEX_SEARCHED"), _short(F.lit("retrieval"), iid)),
        node("evidence", iid, F.concat(F.lit("Evidence "), F.col("evidence_count")), F.lit("SELECTED"), _short(F.lit("evidence"), iid, F.array_join("citations.chunk_id", ","))),
        node("provenance", iid, F.lit("Provenance"), verified, _short(F.lit("provenance"), F.coalesce("bundle_id", F.lit("none")))),
        node("reasoning", iid, F.concat(F.lit("Rule: "), "rule_fired"), F.col("final_decision"), _short(F.lit("reasoning"), F.col("rule_fired"), F.col("final_decision"))),
    )
    cit = F.transform("citations", lambda c: node("citation", F.concat_ws("/", iid, c["citation_id"]), c["citation_text"], c["status"], F.substring(c["source_content_hash"], 1, 16)))
    src = F.transform("citations", lambda c: node("source_log", F.concat_ws("/", iid, c["citation_id"]), c["source_window_id"], F.lit("TRAIN_SPLIT_RECORD"), F.substring(c["source_content_hash"], 1, 16)))
    links = F.array(edge("incident", "window", "evaluates"), edge("window", "score", "computes_signal"), edge("score", "decision", "gates_through"))
    more = F.array(edge("decision", "retrieval", "triggers_retrieval"), edge("retrieval", "evidence", "diversifies"), edge("evidence", "provenance", "verifies_hashes"), edge("provenance", "reasoning", "informs_reasoning"))
    cites = F.transform("citations", lambda c: edge("reasoning", "citation", "cites_evidence", iid, F.concat_ws("/", iid, c["citation_id"])))
    points = F.transform("citations", lambda c: edge("citation", "source_log", "points_to_source", F.concat_ws("/", iid, c["citation_id"]), F.concat_ws("/", iid, c["citation_id"])))
    nodes = assessed.select(iid.alias("incident_id"), "dataset", F.inline(F.when(esc, F.concat(head, body, cit, src)).otherwise(head)))
    edges = assessed.select(iid.alias("incident_id"), F.inline(F.when(esc, F.concat(links, more, cites, points)).otherwise(links)))
    return nodes, edges


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node.

    The nodes are told from the size of the windows' files before each window became many nodes, so
    they'd be broadcast however many they are; the hint keeps the join a shuffle join.
    """
    ids = nodes.select(F.col("incident_id"), F.col("id")).hint("merge")
    ends = edges.select("incident_id", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(ids, ["incident_id", "id"], "left_anti")


PASSPORT_FIELDS = (
    "incident_id", "dataset", "window_id", "anomaly_score", "threshold", "conformal_decision", "final_decision", "severity", "configuration_hash", "evidence_hash", "code_version", "decision_hash",
)


def _decision_hash() -> Column:
    def fixed(fmt: str, c: str) -> Column:
        return F.format_string(fmt, F.col(c))

    parts = F.concat_ws("|", "incident_id", "dataset", "window_id", fixed("%.4f", "anomaly_score"), fixed("%.5f", "threshold"), "conformal_decision", "final_decision", "severity", "configuration_hash", "evidence_hash", "code_version")
    return F.sha2(parts, 256)


def passports(incidents: DataFrame, threshold: float, alpha: float = 0.05, version: str = "1.0", code_version: str = "unknown") -> DataFrame:
    """One decision passport per window, locked by a hash over its decision and provenance."""
    esc = F.col("anomaly_score") > threshold
    out = incidents.select(
        F.col("window_id").alias("incident_id"), "dataset", "window_id", F.round("anomaly_score", 4).alias("anomaly_score"), F.lit(alpha).alias("calibration_alpha"), F.round(F.lit(threshold), 5).alias("threshold"),
        F.when(esc, "ESCALATE").otherwise("AUTO-CLEAR").alias("conformal_decision"), "final_decision", "severity", F.when(esc, "SELECTIVELY_ESCALATED").otherwise("AUTO_CLEARED").alias("escalation_state"),
        "retrieval_count", "evidence_count", "citation_count", "faithfulness_status",
        F.substring(sha(F.concat(F.lit(f"alpha={alpha}:thresh="), F.format_string("%.5f", F.lit(threshold)), F.lit(":dataset="), "dataset", F.lit(f":version={version}"))), 1, 16).alias("configuration_hash"),
        F.substring(sha(F.col("window_id"), *[F.col(c).cast("string") for c in ("retrieval_count", "evidence_count", "citation_count")]), 1, 16).alias("evidence_hash"),
        F.lit(code_version).alias("code_version"),
    )
    ok = F.col("faithfulness_status").isin("VERIFIED", "NOT_APPLICABLE")
    return out.withColumn("decision_hash", _decision_hash()).withColumn("status", F.when(ok, "VERIFIED").otherwise("REVIEW REQUIRED"))


def verify_passports(passports_: DataFrame) -> DataFrame:
    """Add ``authentic`` and ``problem``: a missing field, or a hash that no longer fits."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in PASSPORT_FIELDS])
    problem = F.coalesce(missing, F.when(_decision_hash() != F.col("decision_hash"), F.lit("hash mismatch")))
    return passports_.withColumn("problem", problem).withColumn("authentic", F.col("problem").isNull())


# fixed values: the replay stages in order, and whether a cleared window skips them
REPLAY_STAGES = (
    ("ingest", False), ("parse", False), ("window", False), ("score", False), ("gate", False), ("retrieve", True),
    ("select", True), ("provenance", True), ("reasoning", False), ("explain", True), ("verify", True),
)


def replay(assessments: DataFrame, bundles: DataFrame, explanations: DataFrame) -> DataFrame:
    """Stage rows per window from what was recorded: COMPLETED, SKIPPED when cleared, or UNRESOLVED."""
    keys = ["dataset", "window_id"]
    joined = assessments.join(bundles.select(*keys, F.col("bundle_id").alias("_b")), keys, "left").join(explanations.select(*keys, "explanation_status"), keys, "left")
    esc = F.col("is_escalated")
    seen = {"retrieve": F.col("_b").isNotNull(), "select": F.col("_b").isNotNull(), "provenance": F.col("_b").isNotNull(), "explain": F.col("explanation_status").isNotNull(), "verify": F.col("explanation_status").isNotNull()}
    rows = F.array(*[
        F.struct(F.lit(i).alias("stage_index"), F.lit(name).alias("stage"),
                 (F.when(~esc, "SKIPPED") if skips else F.when(F.lit(False), "")).when(seen.get(name, F.lit(True)), "COMPLETED").otherwise("UNRESOLVED").alias("status"))
        for i, (name, skips) in enumerate(REPLAY_STAGES, 1)
    ])
    return joined.select(*keys, F.inline(rows))


def counterfactuals(scored: DataFrame, hypotheses: Sequence[float], threshold: float, score: str = "anomaly_score") -> DataFrame:
    """The gate's decision under other scores; one row per window and hypothesis."""
    rows = scored.select("window_id", F.col(score).alias("actual_score"), F.explode(F.array(*[F.lit(float(h)) for h in hypotheses])).alias("hypothetical_score"))

    def verdict(c: str) -> Column:
        return F.when(F.col(c) > threshold, "ESCALATE").otherwise("AUTO-CLEAR")

    out = rows.withColumn("actual_decision", verdict("actual_score")).withColumn("hypothetical_decision", verdict("hypothetical_score"))
    return out.withColumn("margin", F.round(F.col("hypothetical_score") - threshold, 4)).withColumn("decision_changed", F.col("actual_decision") != F.col("hypothetical_decision"))


def lookup_windows(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """Window of each request (request_id, window_id, text): by id, else by the session key in its text."""
    asked = requests.withColumn("_key", session_key(F.col("text")))
    by_id = windows.select(F.col("window_id"), F.lit(True).alias("_hit"))
    by_key = windows.filter(F.col("session_id").isNotNull()).groupBy(F.col("session_id").alias("_key")).agg(F.min("window_id").alias("_w"))
    out = asked.join(by_id, "window_id", "left").join(by_key, "_key", "left")
    return out.select("request_id", F.when(F.col("_hit"), F.col("window_id")).otherwise(F.col("_w")).alias("resolved_window_id"), F.when(F.col("_hit"), "window_id").when(F.col("_w").isNotNull(), "session_key").otherwise("none").alias("resolved_by"))


def invariant_audit(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row: how many shared keys disagree on each field."""
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    return left.join(r, list(keys)).agg(F.count(F.lit(1)).alias("compared"), *[F.count_if(~F.col(f).eqNullSafe(F.col(f"_r_{f}"))).alias(f"{f}_mismatches") for f in fields])


# ---- service metrics --------------------------------------------------------------------------


def labelled_counters(events: DataFrame, labels: Sequence[str], value: str, allowed: Sequence[str] = ALLOWED_LABELS) -> DataFrame:
    """Sums per label set; labels that are not allowed are left out of the key."""
    kept = [c for c in labels if c in allowed]
    return events.groupBy(*kept).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("observations"))


def bucket_histogram(events: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Cumulative bucket counts, sum and count. ``inclusive`` decides whether a value on a bound counts."""
    v = F.col(value)
    hits = [F.count_if(v <= b if inclusive else v < b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*by).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), *hits)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")))
    return wide.select(*by, "count", "sum", F.inline(rows))


def service_indicators(events: DataFrame, ok: Column, escalated: Column, by: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    return events.groupBy(*by).agg(n.alias("requests"), F.try_divide(F.count_if(ok), n).alias("success_rate"), F.try_divide(F.count_if(escalated), n).alias("escalation_rate"))


def escalation_gauge(decisions: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    esc = F.count_if(F.col("decision") == "ESCALATE")
    both = F.count_if(F.col("decision").isin("ESCALATE", "AUTO-CLEAR"))
    return decisions.groupBy(*by).agg(F.coalesce(F.round(F.try_divide(esc, both), 4), F.lit(0.0)).alias("escalation_rate"))
