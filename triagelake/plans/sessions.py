"""Sessions through the whole chain: scores, gate, retrieval, citations and assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize
from triagelake.functions.text import lower_key, sha
from triagelake.operators import calibration as cal
from triagelake.operators import provenance as prov
from triagelake.operators import reasoning as rs
from triagelake.operators import retrieval as ret
from triagelake.operators import scorers, splits, windows
from triagelake.operators import selection as sel
from triagelake.operators import sessions as ses
from triagelake.plans import evidence as evp
from triagelake.plans import reason as rsp
from triagelake.plans.base import ALPHA, WINDOWS, rounded, sql
from triagelake.plans.evidence import CITED, EVIDENCE
from triagelake.plans.scoring import B0_B2
from triagelake.sources import tables

#: days of a session, and records of a segment: short ones, so that most sessions here have several
DAYS, SEGMENT = 5, 4


def session_stage(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Sessions with split, B0 and B2 scores, and their records in order."""
    r = tables.event_sessions(spark, sf, DAYS)
    records = materialize(windows.with_session_window(r, "events"), "session-records")
    w = materialize(splits.chronological_split(windows.session_windows(r, windows.any_anomaly_label(r), prefix="events")), "sessions")
    train = w.filter(F.col("split") == "train")
    counts = materialize(windows.template_counts(records), "session-counts")
    known = train.select("dataset", "window_id")
    of_train = counts.join(known, ["dataset", "window_id"], "left_semi")
    scored = scorers.attach_scores(w, scorers.frequency_scores(counts, scorers.fit_frequency(of_train)))
    vocab = scorers.vocabulary(of_train, first_index=2)
    steps = materialize(ses.session_steps(records, vocab, SEGMENT), "session-steps")
    fit = splits.normal_subsplit(train).filter(F.col("subset") == "fit").select("dataset", "window_id")
    model = ses.fit_steps(steps.join(fit, ["dataset", "window_id"], "left_semi"), vocab.count() + 1)
    scored = scorers.attach_scores(scored, ses.step_scores(steps, model), "b2_score")
    return {"windows": materialize(scored, "scored-sessions"), "records": records, "counts": counts}


def session_evidence(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Gate, corpus, idf and top-k evidence of the escalated CALIBRATION sessions."""
    s = session_stage(spark, sf)
    distinct = s["counts"].groupBy("dataset", "window_id").agg(F.count(F.lit(1)).alias("unique_templates"))
    w = materialize(s["windows"].join(ses.content_hashes(s["records"], SEGMENT), ["dataset", "window_id"]).join(distinct, ["dataset", "window_id"]), "hashed-sessions")
    c = w.filter(F.col("split") == "calibration")
    gated = cal.gate(c, cal.threshold_map(c, [ALPHA], score="b2_score")[ALPHA], score="b2_score")
    chunk = sha(lower_key(F.col("dataset")), lower_key(F.col("split")), F.trim("window_id"), F.col("template_hash"))
    corpus = w.filter(F.col("split") == "train").select("dataset", chunk.alias("chunk_id"), F.col("window_id").alias("source_window_id"))
    terms = ses.template_terms(s["counts"], "window_id")
    of_corpus = terms.join(corpus.withColumnRenamed("source_window_id", "window_id"), ["dataset", "window_id"]).select("dataset", "chunk_id", "token", "tf")
    idf = ret.fit_idf(corpus, counts=of_corpus)
    vec = materialize(ret.sparse_vectors(corpus, idf, "chunk_id", of_corpus).join(corpus, ["dataset", "chunk_id"]), "chunk-vectors")
    queries = gated.filter(F.col("decision") == "ESCALATE").select("dataset", F.col("window_id").alias("query_id"))
    asked = terms.withColumnRenamed("window_id", "query_id").join(queries, ["dataset", "query_id"], "left_semi")
    found = materialize(ret.top_k_vectors(ret.sparse_vectors(queries, idf, "query_id", asked), vec, evp.K), "session-evidence")
    return {"windows": w, "records": s["records"], "gated": gated, "vectors": vec, "found": found}


def session_citations_of(e: dict[str, DataFrame]) -> DataFrame:
    c = e["found"].join(e["vectors"].select("dataset", "chunk_id", "vec"), ["dataset", "chunk_id"])
    picked = sel.mmr_picks(sel.candidate_sets(c, sparse=True), evp.EVIDENCE_K, evp.LAM, evp.K)
    return prov.create_citations(sel.selected_rows(picked), e["windows"])


def rehashed(e: dict[str, DataFrame], cited: DataFrame) -> DataFrame:
    """The cited sessions hashed anew from their records."""
    ids = cited.select("dataset", F.col("source_window_id").alias("window_id")).distinct()
    again = ses.content_hashes(e["records"].join(ids, ["dataset", "window_id"], "left_semi"), SEGMENT)
    return e["windows"].drop("source_hash", "template_hash").join(again, ["dataset", "window_id"])


def session_bundles(e: dict[str, DataFrame]) -> DataFrame:
    c = materialize(session_citations_of(e), "session-citations")
    queries = e["gated"].filter(F.col("decision") == "ESCALATE").select("dataset", F.col("window_id").alias("query_id"))
    return prov.create_bundles(queries, prov.verify_citations(c, rehashed(e, c)))


def session_b2(spark, sf):
    return rounded(session_stage(spark, sf)["windows"].select("window_id", "split", "record_count", "score", "b2_score"))


def session_hashes(spark, sf):
    r = materialize(windows.with_session_window(tables.event_sessions(spark, sf, DAYS), "events"), "session-records")
    return ses.content_hashes(r, SEGMENT).select("window_id", "source_hash", "template_hash")


def session_retrieval(spark, sf):
    e = session_evidence(spark, sf)
    out = e["gated"].select(F.col("window_id").alias("query_id"), "decision").join(e["found"].drop("dataset"), "query_id", "left")
    return rounded(out)


def session_citations(spark, sf):
    e = session_evidence(spark, sf)
    c = materialize(session_citations_of(e), "session-citations")
    v = prov.verify_citations(c, rehashed(e, c))
    return rounded(v.select("query_id", "selected_rank", "citation_id", "citation_text", "source_content_hash", "template_content_hash", "status", "reason"))


def session_tampering(spark, sf):
    """Every TRAIN session cited, then verified over records of which some have changed, by cases of the session number."""
    s = session_stage(spark, sf)
    w = s["windows"].join(ses.content_hashes(s["records"], SEGMENT), ["dataset", "window_id"])
    w = materialize(w, "hashed-sessions")
    train = w.filter(F.col("split") == "train")
    chosen = train.select(F.col("window_id").alias("query_id"), "dataset", F.col("window_id").alias("source_window_id"), F.sha2("window_id", 256).alias("chunk_id"),
                          F.lit(1).alias("selected_rank"), F.lit(1.0).alias("retrieval_score"), F.lit(1.0).alias("selection_score"))
    c = prov.create_citations(chosen, w)
    case = F.pmod(F.regexp_extract("window_id", r"u(\d+):", 1).cast("long"), F.lit(10))
    last = F.max("pos").over(_whole_session())
    r = s["records"].withColumn("_case", case).withColumn("_last", last)
    changed = r.withColumn("raw_message", F.when((F.col("_case") == 1) & (F.col("pos") == F.col("_last")), F.concat("raw_message", F.lit("!"))).otherwise(F.col("raw_message")))
    changed = changed.withColumn("template_id", F.when((F.col("_case") == 2) & (F.col("pos") == 0), F.lit(99)).otherwise(F.col("template_id"))).filter(F.col("_case") != 3)
    again = w.drop("source_hash", "template_hash").join(ses.content_hashes(changed, SEGMENT), ["dataset", "window_id"])
    return prov.verify_citations(c, again).select("query_id", "status", "reason")


def _whole_session():
    from pyspark.sql import Window

    return Window.partitionBy("dataset", "window_id")


def session_assessments(spark, sf):
    e = session_evidence(spark, sf)
    a = rs.assess(materialize(rsp.incidents(e, session_bundles(e)), "session-incidents"))
    return rounded(a.select("window_id", "final_decision", "severity", "confidence", "agreement_score", "agreement_level", "rule_fired", F.array_join("rules_evaluated", ",").alias("rules_evaluated"), "sufficiency", "provenance_reason"))


QUERIES = {f.__name__: f for f in (session_b2, session_hashes, session_retrieval, session_citations, session_tampering, session_assessments)}


def _tree(name: str, item: str, separator: str) -> str:
    """CTEs giving ``name`` (window_id, digest): leaves of SEGMENT records, then digests of SEGMENT digests, four levels."""
    out = f"""
{name}0 AS (SELECT window_id, pos // {SEGMENT} AS idx, sha256(string_agg({item}, {separator} ORDER BY pos)) AS digest FROM wrec GROUP BY ALL),
{name}s AS (SELECT *, max(idx) OVER (PARTITION BY window_id) AS last FROM {name}0),"""
    before = f"{name}s"
    for level in range(1, 5):
        out += f"""
{name}{level} AS (SELECT window_id, idx // {SEGMENT} AS idx, CASE WHEN last = 0 THEN any_value(digest) ELSE sha256(string_agg(digest, ',' ORDER BY idx)) END AS digest, last // {SEGMENT} AS last FROM {before} GROUP BY window_id, idx // {SEGMENT}, last),"""
        before = f"{name}{level}"
    return out + f"\n{name} AS (SELECT window_id, digest FROM {before})"


SESSIONS = WINDOWS[: WINDOWS.index(",\nwrec AS")] + f""",
wrec AS (SELECT *, 'events_' || session_id AS window_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_s, line_number) - 1 AS pos FROM (
  SELECT * REPLACE (session_id || ':' || CAST(CAST(floor(ts_s / {86_400 * DAYS}::DOUBLE) AS BIGINT) AS VARCHAR) AS session_id) FROM rec)),
win0 AS (
  SELECT dataset, window_id, arg_min(ts_s, pos) AS start_time, arg_max(ts_s, pos) AS end_time, count(*) AS record_count, arg_min(line_number, pos) AS first_line, arg_max(line_number, pos) AS last_line,
         count(*) FILTER (WHERE is_anomaly) AS anomalous_record_count, bool_or(is_anomaly) AS is_anomaly, list(template_id ORDER BY pos) AS template_ids
  FROM wrec GROUP BY ALL)""" + WINDOWS[WINDOWS.index(",\nruns AS"):]
_HASHES = ",\n" + _tree("src", "trim(raw_message)", "E'\\n'").strip() + "," + _tree("tpl", "'template_' || template_id", "' '")


def over_sessions(ctes: str) -> str:
    """The same stages over sessions: their windows, and tree digests for the texts of fixed windows."""
    out = ctes.replace(WINDOWS, SESSIONS + _HASHES)
    out = out.replace("array_to_string(list_transform(template_ids, lambda t: 'template_' || t), ' ') AS text FROM win)", "digest AS text FROM win JOIN tpl USING (window_id))")
    out = out.replace("msgs AS (SELECT window_id, sha256(string_agg(trim(raw_message), E'\\n' ORDER BY line_number)) AS source_hash FROM wrec GROUP BY 1)", "msgs AS (SELECT window_id, digest AS source_hash FROM src)")
    return out.replace("sha256(text) AS template_content_hash", "text AS template_content_hash")


_CASE = "CAST(regexp_extract(window_id, 'u(\\d+):', 1) AS BIGINT) % 10"
ORACLES = {
    "session_b2": sql(over_sessions(B0_B2), "SELECT window_id, split, record_count, round(score, 6) AS score, round(b2_score, 6) AS b2_score FROM scored0 JOIN b2 USING (window_id)"),
    "session_hashes": sql(over_sessions(WINDOWS), "SELECT window_id, src.digest AS source_hash, tpl.digest AS template_hash FROM src JOIN tpl USING (window_id)"),
    "session_retrieval": sql(over_sessions(EVIDENCE), "SELECT g.window_id AS query_id, decision, rank, round(similarity, 6) AS similarity, chunk_id, source_window_id FROM gated g LEFT JOIN found f ON f.query_id = g.window_id"),
    "session_citations": sql(over_sessions(CITED), "SELECT query_id, selected_rank, citation_id, citation_text, source_content_hash, template_content_hash, 'VALID' AS status, 'ok' AS reason FROM cit"),
    "session_tampering": sql(over_sessions(WINDOWS), f"""
SELECT window_id AS query_id, CASE {_CASE} WHEN 1 THEN 'INVALID' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'UNRESOLVED' ELSE 'VALID' END AS status,
  CASE {_CASE} WHEN 1 THEN 'source_hash_mismatch' WHEN 2 THEN 'template_hash_mismatch' WHEN 3 THEN 'unresolved' ELSE 'ok' END AS reason FROM win WHERE split = 'train'"""),
    "session_assessments": sql(over_sessions(rsp._FULL), rsp.ORACLES["assessments"][len(rsp._FULL) + len("WITH "):]),
}
