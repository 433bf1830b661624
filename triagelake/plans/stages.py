"""The chain as stage tables of one run: read back, replayed from what was recorded, and removed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, scratch_dir
from triagelake.operators import calibration as cal
from triagelake.operators import evaluation as ev
from triagelake.operators import monitoring as mon
from triagelake.operators import provenance as prov
from triagelake.operators import reasoning as rs
from triagelake.operators import registry as reg
from triagelake.operators import retrieval as ret
from triagelake.operators import selection as sel
from triagelake.operators import splits
from triagelake.plans import base, evidence as evp, reason, scoring
from triagelake.plans.audit import _PASS
from triagelake.plans.base import ALPHA, rounded, sql
from triagelake.plans.reason import _FULL
from triagelake.plans.scoring import B0_B2
from triagelake.sources import tables
from triagelake.sources.catalogue import Catalogue
from triagelake.sources.text_logs import block_integrity

SYSTEMS = ("score", "b2_score")


def record_stages(spark: SparkSession, sf: str, run: Catalogue) -> float:
    """Run the chain stage by stage; each reads what the ones before wrote, and records the windows it dealt with.

    Returns the threshold of the gate.
    """
    w = base.event_windows(spark, sf, messages=True)
    for stage in ("ingest", "parse", "window"):
        run.status(stage, w)
    w = run.write("windows", base.b2_scored(base.b0_scored(w)))
    run.status("score", w)
    c = w.filter(F.col("split") == "calibration")
    tau = cal.threshold_map(c, [ALPHA], score="b2_score")[ALPHA]
    gated = run.write("gated", cal.gate(c, tau, score="b2_score"))
    run.status("gate", gated)
    corpus = run.write("corpus", ret.build_corpus(w))
    idf = ret.fit_idf(corpus)
    vectors = run.write("vectors", ret.sparse_vectors(corpus.select("dataset", "chunk_id", "text"), idf, "chunk_id"))
    found = run.write("evidence", ret.gated_retrieval(gated, corpus, idf, evp.K))
    run.status("retrieve", found.withColumnRenamed("query_id", "window_id"))
    sets = sel.candidate_sets(found.join(vectors.select("dataset", "chunk_id", "vec"), ["dataset", "chunk_id"]), sparse=True)
    selected = run.write("selected", sel.selected_rows(sel.mmr_picks(sets, evp.EVIDENCE_K, evp.LAM, evp.K)))
    run.status("select", selected.withColumnRenamed("query_id", "window_id"))
    cited = run.write("citations", prov.verify_citations(prov.create_citations(selected, w), w))
    run.status("provenance", cited.withColumnRenamed("query_id", "window_id"))
    queries = gated.filter(F.col("decision") == "ESCALATE").select("dataset", F.col("window_id").alias("query_id"))
    bundles = run.write("bundles", prov.create_bundles(queries, cited))
    a = run.write("assessments", rs.assess(materialize(reason.incidents({"gated": gated}, bundles), "incidents")))
    run.status("reasoning", a)
    return tau


def recorded_replay(run: Catalogue) -> DataFrame:
    """(dataset, window_id, stage_index, stage, status) of every gated window, from status rows alone.

    A window that the gate cleared skips the stages that only escalated windows take. A stage that recorded no
    row for a window is UNRESOLVED, as are all stages whose table is gone.
    """
    names = [s for s, _ in mon.REPLAY_STAGES]
    asked = run.read("gated").select("dataset", "window_id", "decision")
    rows = F.array(*[F.struct(F.lit(i).alias("stage_index"), F.lit(s).alias("stage"), F.lit(skips).alias("skips")) for i, (s, skips) in enumerate(mon.REPLAY_STAGES, 1)])
    every = asked.select("dataset", "window_id", "decision", F.inline(rows))
    seen = run.statuses(names).withColumnRenamed("status", "_s")
    status = F.when((F.col("decision") == "AUTO-CLEAR") & F.col("skips"), "SKIPPED").otherwise(F.coalesce("_s", F.lit("UNRESOLVED")))
    return every.join(seen, ["dataset", "window_id", "stage"], "left").select("dataset", "window_id", "stage_index", "stage", status.alias("status"))


def recorded_passports(run: Catalogue, threshold: float) -> DataFrame:
    """Passports whose counts and states are those of the recorded stages; no explanation on record is UNRESOLVED."""
    a = run.read("assessments")
    per = lambda name, out: run.read(name).groupBy("dataset", F.col("query_id").alias("window_id")).agg(F.count(F.lit(1)).alias(out))
    keys = ["dataset", "window_id"]
    counted = a.join(per("evidence", "retrieval_count"), keys, "left").join(per("selected", "_selected"), keys, "left").join(per("citations", "citation_count"), keys, "left")
    explained = run.statuses(["verify"]).select(*keys, F.lit("VERIFIED").alias("_f"))
    counted = counted.join(explained, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    faith = F.when(~F.col("is_escalated"), "NOT_APPLICABLE").otherwise(F.coalesce("_f", F.lit("UNRESOLVED")))
    rows = counted.select(*keys, "anomaly_score", "final_decision", "severity", zero("retrieval_count").alias("retrieval_count"), zero("_selected").alias("evidence_count"), zero("citation_count").alias("citation_count"), faith.alias("faithfulness_status"))
    return mon.passports(rows, threshold)


def _result(run: Catalogue, df: DataFrame) -> DataFrame:
    """The answer as the run's only table left."""
    out = run.write("result", df)
    run.keep("result")
    return out


def assessments_from_stages(spark, sf):
    with Catalogue(spark) as run:
        record_stages(spark, sf, run)
        a = run.read("assessments")
        return _result(run, rounded(a.select("window_id", "final_decision", "severity", "confidence", "agreement_score", "agreement_level", "rule_fired", F.array_join("rules_evaluated", ",").alias("rules_evaluated"), "sufficiency", "provenance_reason")))


def replay_recorded(spark, sf):
    with Catalogue(spark) as run:
        record_stages(spark, sf, run)
        return _result(run, rounded(recorded_replay(run).drop("dataset")))


def replay_after_loss(spark, sf):
    """The same replay where the retrieval stage and the scores were lost."""
    with Catalogue(spark) as run:
        record_stages(spark, sf, run)
        run.remove("status-retrieve", "status-score", "evidence")
        return _result(run, rounded(recorded_replay(run).drop("dataset")))


def passports_recorded(spark, sf):
    with Catalogue(spark) as run:
        tau = record_stages(spark, sf, run)
        return _result(run, rounded(recorded_passports(run, tau).drop("dataset", "code_version")))


def _registry(spark) -> str:
    return f"{scratch_dir(spark)}/registry-{uuid.uuid4().hex}"


def _frozen(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(scored windows, thresholds read back): frozen twice by one run and once by a later one with fewer rows."""
    w = base.scored_stage(spark, sf, b2=True)
    c = w.filter(F.col("split") == "calibration")
    path = _registry(spark)
    first = reg.threshold_rows(c.filter(F.col("is_anomaly")), SYSTEMS).withColumn("seq", F.lit(1))
    rows = reg.threshold_rows(c, SYSTEMS).withColumn("seq", F.lit(2))
    reg.register(first, path, "first")
    reg.register(rows, path, "second")
    reg.register(rows, path, "second")
    return w, reg.latest(reg.registered(spark, path), ["dataset", "system", "rule", "level"], ["seq"])


def frozen_thresholds(spark, sf):
    return rounded(_frozen(spark, sf)[1].select("dataset", "system", "rule", "level", "threshold", "n"))


def classify_frozen(spark, sf):
    w, t = _frozen(spark, sf)
    return rounded(reg.classify_frozen(w, t, SYSTEMS, "quantile", 0.95).drop("dataset"))


def run_registry(spark, sf):
    """TEST metrics of two runs, registered twice each: what the registry holds, and the latest per system."""
    w = base.scored_stage(spark, sf, b2=True)
    test = splits.read_split(w, "test", evaluate=True)
    path = _registry(spark)
    for seq, (run, q) in enumerate((("loose", 0.90), ("strict", 0.95)), 1):
        t = {r["system"]: r["threshold"] for r in reg.threshold_rows(w.filter(F.col("split") == "calibration"), SYSTEMS, q).filter("rule = 'quantile'").collect()}
        long = test.select("dataset", "window_id", "y", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), (F.col(s) > t[s]).cast("int").alias("pred")) for s in SYSTEMS])))
        m = cal.confusion(long, F.col("pred") == 1, F.col("y"), ["system"]).withColumn("seq", F.lit(seq))
        for _ in range(2):
            reg.register(m, path, run)
    held = materialize(reg.registered(spark, path), "registry")
    last = reg.latest(held, ["system"], ["seq"]).select("run_id", "system", F.lit(True).alias("is_latest"))
    return rounded(held.join(last, ["run_id", "system"], "left").select("run_id", "system", "seq", "tp", "fp", "tn", "fn", F.coalesce("is_latest", F.lit(False)).alias("is_latest")))


def baseline_suite(spark, sf):
    """Frequency, components, forest and sequence model side by side on CALIBRATION: threshold, counts, ranking."""
    w, f, train, d = scoring._features(spark, sf)
    s = base.b2_scored(base.b0_scored(w))
    s = scoring.scorers.attach_scores(s, scoring.scorers.pca_scores(f, d, scoring.scorers.fit_pca(train, d)), "pca")
    s = scoring.scorers.attach_scores(s, scoring.scorers.isolation_scores(f, d, scoring.scorers.fit_isolation_forest(train, d)), "forest")
    c = materialize(s.filter(F.col("split") == "calibration"), "suite")
    systems = ("score", "pca", "forest", "b2_score")
    long = materialize(c.select("dataset", "window_id", "y", F.inline(F.array(*[F.struct(F.lit(x).alias("system"), F.col(x).alias("score")) for x in systems]))), "suite-long")
    t = cal.quantile_threshold(long, 0.95, ["dataset", "system"])
    pred = long.join(t.drop("n"), ["dataset", "system"]).withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))
    table = ev.benchmark_table(pred)
    return rounded(table.join(t.select("dataset", "system", "threshold"), ["dataset", "system"]).drop("dataset"))


def input_integrity(spark, sf):
    """Block digests of the given event and order files."""
    both = None
    for name in ("events", "orders"):
        d = block_integrity(spark, f"{sf}/{name}.parquet", 1 << 20)
        both = d if both is None else both.unionByName(d)
    return both.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "n_blocks", "digest")


QUERIES = {f.__name__: f for f in (assessments_from_stages, replay_recorded, replay_after_loss, passports_recorded, frozen_thresholds, classify_frozen, run_registry, baseline_suite, input_integrity)}


def _replay(lost: tuple[str, ...]) -> str:
    rows = []
    for i, (name, skips) in enumerate(mon.REPLAY_STAGES, 1):
        done = {"retrieve": "r > 0", "select": "n > 0", "provenance": "n > 0", "explain": "false", "verify": "false"}.get(name, "true")
        done = "false" if name in lost else done
        cleared = "WHEN NOT esc THEN 'SKIPPED'" if skips else ""
        rows.append(f"SELECT window_id, CAST({i} AS BIGINT) AS stage_index, '{name}' AS stage, CASE {cleared} WHEN {done} THEN 'COMPLETED' ELSE 'UNRESOLVED' END AS status FROM rp")
    return " UNION ALL ".join(rows)


_FOUND = _FULL + ", fc AS (SELECT query_id AS window_id, count(*) AS r FROM found GROUP BY 1), rp AS (SELECT ass.*, coalesce(r, 0) AS r FROM ass LEFT JOIN fc USING (window_id))"
_RECORDED = (
    _PASS.replace(",\npp AS (", ", fc AS (SELECT query_id AS window_id, count(*) AS r FROM found GROUP BY 1),\npp AS (")
    .replace("CAST(CASE WHEN esc THEN 5 ELSE 0 END AS BIGINT)", "CAST(coalesce(r, 0) AS BIGINT)").replace("CASE WHEN esc THEN 5 ELSE 0 END", "coalesce(r, 0)")
    .replace("CASE WHEN esc THEN 'VERIFIED' ELSE", "CASE WHEN esc THEN 'UNRESOLVED' ELSE").replace("FROM ass, tau2)", "FROM ass LEFT JOIN fc USING (window_id), tau2)")
)
_LONG = B0_B2 + """,
two AS (SELECT dataset, scored0.window_id, split, y, unnest(['score', 'b2_score']) AS system, unnest([score, b2_score]) AS s FROM scored0 JOIN b2 USING (window_id)),
cal AS (SELECT system, s, row_number() OVER (PARTITION BY system ORDER BY s) AS k, count(*) OVER (PARTITION BY system) AS n FROM two WHERE split = 'calibration')"""
ORACLES = {
    "assessments_from_stages": reason.ORACLES["assessments"],
    "replay_recorded": sql(_FOUND, _replay(())),
    "replay_after_loss": sql(_FOUND, _replay(("retrieve", "score"))),
    "passports_recorded": sql(_RECORDED, "SELECT window_id AS incident_id, window_id, anomaly_score, calibration_alpha, threshold, conformal_decision, final_decision, severity, escalation_state, retrieval_count, evidence_count, citation_count, faithfulness_status, configuration_hash, evidence_hash, decision_hash, CASE WHEN faithfulness_status = 'UNRESOLVED' THEN 'REVIEW REQUIRED' ELSE 'VERIFIED' END AS status FROM ph"),
    "frozen_thresholds": sql(_LONG, """
SELECT 'events' AS dataset, system, 'quantile' AS rule, 0.95::DOUBLE AS level, round(quantile_cont(s, 0.95::DOUBLE), 6) AS threshold, count(*) AS n FROM cal GROUP BY system
UNION ALL SELECT 'events', system, 'conformal', a, round(min(s), 6), any_value(n) FROM cal, (SELECT CAST(unnest([0.01, 0.05, 0.10, 0.20]) AS DOUBLE) AS a) WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - a)))) GROUP BY system, a"""),
    "classify_frozen": sql(_LONG, "SELECT window_id, split, system, CAST(s > (SELECT quantile_cont(s, 0.95::DOUBLE) FROM cal c WHERE c.system = two.system) AS BIGINT) AS pred FROM two"),
    "run_registry": sql(_LONG, """
SELECT run_id, system, seq, count(*) FILTER (WHERE s > t AND y = 1) AS tp, count(*) FILTER (WHERE s > t AND y = 0) AS fp, count(*) FILTER (WHERE s <= t AND y = 0) AS tn, count(*) FILTER (WHERE s <= t AND y = 1) AS fn, run_id = 'strict' AS is_latest
FROM two JOIN (SELECT 'loose' AS run_id, CAST(1 AS BIGINT) AS seq, system, quantile_cont(s, 0.90::DOUBLE) AS t FROM cal GROUP BY system UNION ALL SELECT 'strict', 2, system, quantile_cont(s, 0.95::DOUBLE) FROM cal GROUP BY system) USING (system)
WHERE split = 'test' GROUP BY run_id, system, seq"""),
}
