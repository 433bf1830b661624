"""Queries over retrieval, evidence selection, citations and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize
from triagelake.operators import calibration as cal
from triagelake.operators import provenance as prov
from triagelake.operators import retrieval as ret
from triagelake.operators import selection as sel
from triagelake.plans import base
from triagelake.plans.base import ALPHA, WINDOWS, rounded, sql
from triagelake.plans.scoring import B0_B2
from triagelake.sources import tables

K, EVIDENCE_K, LAM = 5, 3, 0.7


def gated_windows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all scored windows with their messages, the gated CALIBRATION windows)."""
    w = materialize(base.b2_scored(base.b0_scored(base.event_windows(spark, sf_dir, messages=True))), "scored")
    c = w.filter(F.col("split") == "calibration")
    tau = cal.threshold_map(c, [ALPHA], score="b2_score")[ALPHA]
    return w, cal.gate(c, tau, score="b2_score")


def evidence(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Gate, corpus, idf and the top-k candidates of the escalated windows."""
    w, gated = gated_windows(spark, sf_dir)
    corpus = ret.build_corpus(w)
    idf = ret.fit_idf(corpus)
    found = materialize(ret.gated_retrieval(gated, corpus, idf, K), "evidence")
    return {"windows": w, "gated": gated, "corpus": corpus, "idf": idf, "found": found}


def candidate_vectors(e: dict[str, DataFrame]) -> DataFrame:
    """Candidates with the vectors of the retrieved chunks only."""
    chunks = e["corpus"].join(e["found"].select("dataset", "chunk_id").distinct(), ["dataset", "chunk_id"], "left_semi")
    vec = ret.sparse_vectors(chunks.select("dataset", "chunk_id", "text"), e["idf"], "chunk_id").select("dataset", "chunk_id", "vec")
    return e["found"].join(vec, ["dataset", "chunk_id"])


def picked(e: dict[str, DataFrame]) -> DataFrame:
    return sel.mmr_picks(sel.candidate_sets(candidate_vectors(e), sparse=True), EVIDENCE_K, LAM, K)


def citations(e: dict[str, DataFrame]) -> DataFrame:
    return prov.create_citations(sel.selected_rows(picked(e)), e["windows"])


def bundles(e: dict[str, DataFrame]) -> DataFrame:
    verified = prov.verify_citations(citations(e), e["windows"])
    queries = e["gated"].filter(F.col("decision") == "ESCALATE").select("dataset", F.col("window_id").alias("query_id"))
    return prov.create_bundles(queries, verified)


def corpus_chunks(spark, sf):
    return ret.build_corpus(base.event_windows(spark, sf)).select("chunk_id", "source_window_id", "text")


def tfidf_weights(spark, sf):
    c = ret.build_corpus(base.event_windows(spark, sf))
    idf = ret.fit_idf(c)
    return rounded(ret.tfidf_weights(ret.token_counts(c, "source_window_id"), idf, "source_window_id").drop("dataset"))


def tfidf_idf(spark, sf):
    return rounded(ret.fit_idf(ret.build_corpus(base.event_windows(spark, sf))))


def document_idf(spark, sf):
    """The same fit over free text."""
    d = tables.table(spark, sf, "documents").select(F.lit("documents").alias("dataset"), "doc_id", "text")
    return rounded(ret.fit_idf(d, "doc_id", frequencies=ret.document_frequencies(d, "doc_id")))


def vocabulary_hash(spark, sf):
    return ret.vocabulary_hash(ret.fit_idf(ret.build_corpus(base.event_windows(spark, sf))))


def gated_retrieval(spark, sf):
    e = evidence(spark, sf)
    out = e["gated"].select(F.col("window_id").alias("query_id"), "decision").join(e["found"].drop("dataset"), "query_id", "left")
    return rounded(out)


def retrieval_diagnostics(spark, sf):
    e = evidence(spark, sf)
    return rounded(ret.retrieval_diagnostics(e["gated"], e["found"], e["corpus"]))


def retrieval_spread(spark, sf):
    e = evidence(spark, sf)
    return rounded(ret.retrieval_spread(e["gated"], e["found"], e["corpus"], e["idf"]))


def tfidf_topk(spark, sf):
    """Every CALIBRATION window as a query."""
    w = base.event_windows(spark, sf)
    c = ret.build_corpus(w)
    return rounded(ret.top_k(ret.build_queries(w.filter(F.col("split") == "calibration")), c, ret.fit_idf(c), 3).drop("dataset"))


def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense_topk(spark, sf):
    v = _vectors(spark, sf)
    return rounded(ret.dense_top_k(v, v, K))


def _dense_sets(spark, sf):
    v = _vectors(spark, sf)
    found = materialize(ret.dense_top_k(v, v, K), "dense")
    c = found.join(v.select("dataset", F.col("id").cast("string").alias("chunk_id"), "vec"), ["dataset", "chunk_id"]).withColumn("source_window_id", F.col("chunk_id"))
    return sel.candidate_sets(c)


def mmr_select(spark, sf):
    return rounded(sel.selected_rows(sel.mmr_picks(_dense_sets(spark, sf), EVIDENCE_K, LAM, K)).drop("dataset", "source_window_id"), keep=("selection_score",))


def mmr_metrics(spark, sf):
    return rounded(sel.selection_metrics(sel.mmr_picks(_dense_sets(spark, sf), EVIDENCE_K, LAM, K), K).drop("dataset"))


def mmr_lambda_sweep(spark, sf):
    return rounded(sel.lambda_sweep(_dense_sets(spark, sf)))


def mmr_budget_sweep(spark, sf):
    return rounded(sel.budget_sweep(_dense_sets(spark, sf)))


def mmr_versus_top(spark, sf):
    return rounded(sel.top_versus_mmr(_dense_sets(spark, sf)))


def gated_evidence(spark, sf):
    return rounded(sel.selected_rows(picked(evidence(spark, sf))).drop("dataset"), keep=("selection_score",))


def reranking_diagnostics(spark, sf):
    e = evidence(spark, sf)
    p = materialize(picked(e), "picked")
    return rounded(sel.reranking_diagnostics(sel.selection_metrics(p, K), e["found"], sel.selected_rows(p)))


def content_hashes(spark, sf):
    w = base.event_windows(spark, sf, messages=True)
    return w.select("window_id", prov.source_hash(F.col("raw_messages")).alias("source_hash"), prov.text_hash(ret.template_text(F.col("template_ids"))).alias("template_hash"))


def citation_ids(spark, sf):
    c = citations(evidence(spark, sf))
    return rounded(c.select("query_id", "selected_rank", "citation_id", "citation_text", "source_content_hash", "template_content_hash"))


def citation_bundles(spark, sf):
    b = bundles(evidence(spark, sf))
    return rounded(b.select("query_id", "bundle_id", "evidence_count", "all_verified"))


def bundle_verification(spark, sf):
    return rounded(prov.verify_bundles(bundles(evidence(spark, sf))).drop("dataset", "bundle_id"))


def provenance_diagnostics(spark, sf):
    e = evidence(spark, sf)
    return rounded(prov.provenance_diagnostics(prov.verify_citations(citations(e), e["windows"])))


def tamper_detection(spark, sf):
    """Citations over every TRAIN window, with a fault put into most, by cases of the window number."""
    w = base.event_windows(spark, sf, messages=True)
    train = w.filter(F.col("split") == "train")
    chunk = ret.chunk_id(F.col("dataset"), F.col("split"), F.col("window_id"), ret.template_text(F.col("template_ids")))
    s = train.select(F.col("window_id").alias("query_id"), "dataset", F.col("window_id").alias("source_window_id"), chunk.alias("chunk_id"),
                     F.lit(1).alias("selected_rank"), F.lit(1.0).alias("retrieval_score"), F.lit(1.0).alias("selection_score"))
    c = prov.create_citations(s, w)
    case = F.substring("source_window_id", -1, 1)
    c = c.withColumn("case", case)
    c = c.withColumn("source_content_hash", F.when(case == "1", F.sha2("citation_id", 256)).otherwise(F.col("source_content_hash")))
    c = c.withColumn("template_content_hash", F.when(case == "2", F.sha2("citation_id", 256)).otherwise(F.col("template_content_hash")))
    c = c.withColumn("split", F.when(case == "3", "test").otherwise(F.col("split")))
    c = c.withColumn("citation_id", F.when(case == "4", F.reverse("citation_id")).otherwise(F.col("citation_id")))
    gone = F.concat(F.lit("missing_"), F.col("source_window_id"))
    moved = c.withColumn("source_window_id", F.when(case == "5", gone).otherwise(F.col("source_window_id")))
    loc = F.col("source_location")
    fresh = prov.citation_id(F.col("dataset"), F.col("split"), F.col("chunk_id"), F.col("source_window_id"), loc["line_start"], loc["line_end"])
    moved = moved.withColumn("citation_id", F.when(case == "5", fresh).otherwise(F.col("citation_id")))
    return prov.verify_citations(moved, w).select("query_id", "status", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_chunks, tfidf_weights, tfidf_idf, document_idf, vocabulary_hash, gated_retrieval, retrieval_diagnostics, retrieval_spread, tfidf_topk, dense_topk, mmr_select, mmr_metrics,
        mmr_lambda_sweep, mmr_budget_sweep, mmr_versus_top, gated_evidence, reranking_diagnostics, content_hashes, citation_ids, citation_bundles,
        bundle_verification, provenance_diagnostics, tamper_detection,
    )
}

_TFIDF = """,
txt AS (SELECT window_id, split, first_line, last_line, record_count, is_anomaly, array_to_string(list_transform(template_ids, lambda t: 'template_' || t), ' ') AS text FROM win),
chunk AS (SELECT *, sha256('events:train:' || window_id || ':' || text) AS chunk_id FROM txt WHERE split = 'train'),
tc AS (SELECT window_id, 'template_' || template_id AS token, count(*) AS tf FROM wrec GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM chunk)) / (count(*) + 1)) + 1 AS idf FROM tc JOIN chunk USING (window_id) GROUP BY token),
wt AS (SELECT window_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY window_id)) AS w FROM tc JOIN idf USING (token)),
w9 AS (SELECT window_id, token, round(w, 9) AS w FROM wt),
dk AS (SELECT window_id, string_agg(token || ':' || w, ',' ORDER BY token) AS dir FROM w9 GROUP BY 1)"""


def _topk_sql(queries: str, k: int) -> str:
    """CTE ``found``: top-k chunks of the windows named by a (query_id) source."""
    return f""",
dots AS (SELECT q.query_id, c.window_id, sum(a.w * b.w) AS dot FROM {queries} q JOIN w9 a ON a.window_id = q.query_id JOIN w9 b ON b.token = a.token JOIN chunk c ON c.window_id = b.window_id GROUP BY ALL),
sims AS (
  SELECT q.query_id, c.chunk_id, c.window_id AS source_window_id,
    CASE WHEN x.dir = y.dir THEN 1.0::DOUBLE ELSE least(round(coalesce(dot, 0.0::DOUBLE), 6), 0.999999::DOUBLE) END AS similarity
  FROM {queries} q CROSS JOIN chunk c LEFT JOIN dots ON dots.query_id = q.query_id AND dots.window_id = c.window_id
  LEFT JOIN dk x ON x.window_id = q.query_id LEFT JOIN dk y ON y.window_id = c.window_id WHERE c.window_id <> q.query_id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims) WHERE rank <= {k})"""


def mmr_sql(lam: str = "0.7", k: int = 3, tag: str = "") -> str:
    """CTEs over ``found`` and ``pairs`` (query_id, a, b, sim); the picks end up in ``mmr``."""
    out = f""",
m{tag}1 AS (SELECT query_id, chunk_id, rank AS rr, similarity AS rel, similarity AS score, 0.0::DOUBLE AS pen, CAST(1 AS BIGINT) AS sr FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS o FROM found) WHERE o = 1)"""
    for i in range(2, k + 1):
        prev = " UNION ALL ".join(f"SELECT query_id, chunk_id FROM m{tag}{j}" for j in range(1, i))
        out += f""",
m{tag}{i} AS (SELECT query_id, chunk_id, rank AS rr, rel, score, pen, CAST({i} AS BIGINT) AS sr FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel DESC, chunk_id) AS o FROM (
    SELECT f.query_id, f.chunk_id, f.rank, f.similarity AS rel, max(p.sim) AS pen,
      round({lam}::DOUBLE * f.similarity - (1.0::DOUBLE - {lam}::DOUBLE) * max(p.sim), 9) AS score
    FROM found f JOIN ({prev}) s ON s.query_id = f.query_id JOIN pairs p ON p.query_id = f.query_id AND p.a = f.chunk_id AND p.b = s.chunk_id
    WHERE NOT EXISTS (SELECT 1 FROM ({prev}) t WHERE t.query_id = f.query_id AND t.chunk_id = f.chunk_id) GROUP BY f.query_id, f.chunk_id, f.rank, f.similarity)) WHERE o = 1)"""
    return out + f",\nmmr{tag} AS (" + " UNION ALL ".join(f"SELECT * FROM m{tag}{i}" for i in range(1, k + 1)) + ")"


EVIDENCE = B0_B2 + _TFIDF + """,
cal2 AS (SELECT window_id, b2_score, row_number() OVER (ORDER BY b2_score) AS k, count(*) OVER () AS n FROM b2 JOIN win USING (window_id) WHERE split = 'calibration'),
tau2 AS (SELECT min(b2_score) AS tau FROM cal2 WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0::DOUBLE - 0.05::DOUBLE))))),
gated AS (SELECT window_id, b2_score, CASE WHEN b2_score > tau THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS decision FROM cal2, tau2),
esc AS (SELECT window_id AS query_id FROM gated WHERE decision = 'ESCALATE')""" + _topk_sql("esc", K)

SELECTED = EVIDENCE + """,
vn AS (SELECT window_id, sum(w * w) AS nn FROM w9 GROUP BY 1),
pd AS (SELECT f.query_id, f.chunk_id AS a, g.chunk_id AS b, sum(x.w * y.w) AS dot, any_value(sqrt(vx.nn) * sqrt(vy.nn)) AS nrm
  FROM found f JOIN found g USING (query_id) JOIN w9 x ON x.window_id = f.source_window_id JOIN w9 y ON y.window_id = g.source_window_id AND y.token = x.token
  JOIN vn vx ON vx.window_id = f.source_window_id JOIN vn vy ON vy.window_id = g.source_window_id GROUP BY ALL),
pairs AS (SELECT f.query_id, f.chunk_id AS a, g.chunk_id AS b, coalesce(least(1.0::DOUBLE, round(dot / nrm, 6)), 0.0::DOUBLE) AS sim
  FROM found f JOIN found g USING (query_id) LEFT JOIN pd ON pd.query_id = f.query_id AND pd.a = f.chunk_id AND pd.b = g.chunk_id)""" + mmr_sql()

CITED = SELECTED + """,
msgs AS (SELECT window_id, sha256(string_agg(trim(raw_message), E'\\n' ORDER BY line_number)) AS source_hash FROM wrec GROUP BY 1),
cit AS (
  SELECT m.query_id, m.sr AS selected_rank, m.rel AS retrieval_score, m.score AS selection_score, c.chunk_id, c.window_id AS source_window_id,
    sha256('events:train:' || c.chunk_id || ':' || c.window_id || ':' || first_line || ':' || last_line) AS citation_id,
    '[EVENTS | train | window=' || c.window_id || ' | lines=' || first_line || '-' || last_line || ' | records=' || record_count || ']' AS citation_text,
    source_hash AS source_content_hash, sha256(text) AS template_content_hash, first_line AS line_start, last_line AS line_end, record_count
  FROM mmr m JOIN chunk c USING (chunk_id) JOIN msgs USING (window_id)),
bun AS (
  SELECT e.query_id, count(citation_id) AS evidence_count, sha256('events:1.0:' || coalesce(string_agg(citation_id, ',' ORDER BY selected_rank), '')) AS bundle_id, true AS all_verified
  FROM esc e LEFT JOIN cit USING (query_id) GROUP BY 1)"""

_DENSE = """
v AS (SELECT CAST(label AS VARCHAR) AS dataset, CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT dataset, id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
ps AS (SELECT a.dataset, a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS sim FROM u a JOIN u b USING (dataset)),
found AS (SELECT dataset, query_id, chunk_id, similarity, rank FROM (
  SELECT dataset, a AS query_id, b AS chunk_id, sim AS similarity, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM ps WHERE a <> b) WHERE rank <= 5),
pairs AS (SELECT f.query_id, f.chunk_id AS a, g.chunk_id AS b, ps.sim FROM found f JOIN found g USING (query_id) JOIN ps ON ps.a = f.chunk_id AND ps.b = g.chunk_id)"""


def _sweep_sql(m: str, key: str) -> str:
    return f"""
SELECT {key}, round((SELECT sum(rel) / count(*) FROM {m}), 4) AS mean_relevance, round((SELECT avg(p) FROM (
  SELECT query_id, round(avg(sim), 4) AS p FROM (SELECT x.query_id, coalesce(p.sim, 0.0::DOUBLE) AS sim FROM {m} x LEFT JOIN {m} y ON y.query_id = x.query_id AND y.sr > x.sr LEFT JOIN pairs p ON p.query_id = x.query_id AND p.a = x.chunk_id AND p.b = y.chunk_id
    WHERE y.sr IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {m} z WHERE z.query_id = x.query_id AND z.sr > 1)) GROUP BY 1)), 4) AS mean_pairwise_similarity"""


ORACLES = {
    "corpus_chunks": sql(WINDOWS + _TFIDF, "SELECT chunk_id, window_id AS source_window_id, text FROM chunk"),
    "tfidf_weights": sql(WINDOWS + _TFIDF, "SELECT window_id AS source_window_id, token, round(w, 6) AS weight FROM wt JOIN chunk USING (window_id)"),
    "tfidf_idf": sql(WINDOWS + _TFIDF, "SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "document_idf": r"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(text), E' \t\n\r'), '\s+')) AS token FROM documents),
d AS (SELECT token, count(DISTINCT doc_id) AS df FROM t WHERE token <> '' GROUP BY 1)
SELECT token, df, round(ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (df + 1)) + 1, 6) AS idf FROM d""",
    "vocabulary_hash": sql(WINDOWS + _TFIDF + """,
vv AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i FROM idf),
vg AS (SELECT left(sha256(token), 3) AS g, sha256(string_agg(token || ':' || i, ',' ORDER BY token)) AS h FROM vv GROUP BY 1)""", "SELECT sha256(string_agg(h, ',' ORDER BY g)) AS vocabulary_hash, count(*) AS groups FROM vg"),
    "reranking_diagnostics": sql(SELECTED + """,
cp AS (SELECT query_id, avg(sim) AS m FROM pairs p JOIN found x USING (query_id) JOIN found y USING (query_id) WHERE p.a = x.chunk_id AND p.b = y.chunk_id AND x.rank < y.rank GROUP BY 1),
sp AS (SELECT x.query_id, avg(sim) AS m FROM mmr x JOIN mmr y ON x.query_id = y.query_id AND x.sr < y.sr JOIN pairs p ON p.query_id = x.query_id AND p.a = x.chunk_id AND p.b = y.chunk_id GROUP BY 1),
qs AS (SELECT query_id, round(coalesce(cp.m, 0.0::DOUBLE), 4) AS c, round(coalesce(sp.m, 0.0::DOUBLE), 4) AS s FROM (SELECT DISTINCT query_id FROM found) LEFT JOIN cp USING (query_id) LEFT JOIN sp USING (query_id)),
sd AS (SELECT m.query_id, m.chunk_id, f.source_window_id, m.rel FROM mmr m JOIN found f USING (query_id, chunk_id))""", """
SELECT (SELECT count(*) FROM qs) AS queries, (SELECT round(avg(c), 4) FROM qs) AS mean_candidate_pairwise_similarity, (SELECT round(avg(s), 4) FROM qs) AS mean_selected_pairwise_similarity,
  c.*, s.*, round((c.candidate_total_chunks - c.candidate_unique_chunks) / CAST(c.candidate_total_chunks AS DOUBLE), 4) AS candidate_duplicate_rate, round((s.selected_total_chunks - s.selected_unique_chunks) / CAST(s.selected_total_chunks AS DOUBLE), 4) AS selected_duplicate_rate
FROM (SELECT count(*) AS candidate_total_chunks, count(DISTINCT chunk_id) AS candidate_unique_chunks, count(DISTINCT source_window_id) AS candidate_unique_source_windows, round(avg(similarity), 4) AS mean_candidate_similarity FROM found) c,
  (SELECT count(*) AS selected_total_chunks, count(DISTINCT chunk_id) AS selected_unique_chunks, count(DISTINCT source_window_id) AS selected_unique_source_windows, round(avg(rel), 4) AS mean_selected_similarity FROM sd) s"""),
    "gated_retrieval": sql(EVIDENCE, "SELECT g.window_id AS query_id, decision, rank, round(similarity, 6) AS similarity, chunk_id, source_window_id FROM gated g LEFT JOIN found f ON f.query_id = g.window_id"),
    "retrieval_diagnostics": sql(EVIDENCE, """
SELECT (SELECT count(*) FROM gated) AS total_windows, (SELECT count(*) FROM esc) AS escalated_count, count(*) AS total_chunks, count(DISTINCT chunk_id) AS unique_chunks,
  min(similarity) AS sim_min, max(similarity) AS sim_max, round(avg(similarity), 6) AS sim_mean, count(*) FILTER (WHERE is_anomaly) AS anomalous_chunks, (SELECT count(*) FROM chunk) AS corpus_size,
  round((SELECT count(*) FROM esc) / CAST((SELECT count(*) FROM gated) AS DOUBLE), 6) AS escalation_rate, round((count(*) - count(DISTINCT chunk_id)) / CAST(count(*) AS DOUBLE), 6) AS duplicate_retrieval_rate,
  round(count(*) FILTER (WHERE is_anomaly) / CAST(count(*) AS DOUBLE), 6) AS anomalous_evidence_ratio FROM found JOIN chunk USING (chunk_id)"""),
    "retrieval_spread": sql(EVIDENCE + """,
norms AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM chunk JOIN wt USING (window_id) GROUP BY 1)""", """
SELECT (SELECT count(*) FROM gated) AS total_windows, (SELECT count(*) FROM gated WHERE decision <> 'ESCALATE') AS auto_clear_count,
  round((SELECT count(*) FILTER (WHERE decision <> 'ESCALATE') / CAST(count(*) AS DOUBLE) FROM gated), 6) AS auto_clear_rate,
  round(quantile_cont(similarity, 0.25), 6) AS sim_p25, round(quantile_cont(similarity, 0.5), 6) AS sim_median, round(quantile_cont(similarity, 0.75), 6) AS sim_p75,
  round(count(*) FILTER (WHERE source_window_id = query_id) / CAST(count(*) AS DOUBLE), 6) AS self_retrieval_rate,
  (SELECT count(*) FROM chunk) - (SELECT count(*) FROM norms WHERE norm > 0) AS zero_vector_count,
  round((SELECT sum(norm) FROM norms) / (SELECT count(*) FROM chunk), 6) AS mean_vector_norm FROM found"""),
    "tfidf_topk": sql(WINDOWS + _TFIDF + ", qs AS (SELECT window_id AS query_id FROM win WHERE split = 'calibration')" + _topk_sql("qs", 3), "SELECT query_id, rank, round(similarity, 6) AS similarity, chunk_id, source_window_id FROM found"),
    "dense_topk": sql(_DENSE, "SELECT dataset, query_id, rank, similarity, chunk_id FROM found"),
    "mmr_select": sql(_DENSE + mmr_sql(), "SELECT query_id, sr AS selected_rank, chunk_id, rr AS retrieval_rank, rel AS retrieval_score, score AS selection_score, pen AS redundancy_penalty FROM mmr"),
    "mmr_metrics": sql(_DENSE + mmr_sql() + """,
cp AS (SELECT query_id, avg(sim) AS m FROM pairs p JOIN found x USING (query_id) JOIN found y USING (query_id) WHERE p.a = x.chunk_id AND p.b = y.chunk_id AND x.rank < y.rank GROUP BY 1),
sp AS (SELECT x.query_id, avg(sim) AS m, max(sim) AS mx FROM mmr x JOIN mmr y ON x.query_id = y.query_id AND x.sr < y.sr JOIN pairs p ON p.query_id = x.query_id AND p.a = x.chunk_id AND p.b = y.chunk_id GROUP BY 1),
cs AS (SELECT query_id, count(*) AS c, avg(similarity) AS m FROM found GROUP BY 1), ss AS (SELECT query_id, count(*) AS c, avg(rel) AS m FROM mmr GROUP BY 1)""", """
SELECT query_id, cs.c AS candidate_count, ss.c AS selected_count, round(ss.c / 5.0::DOUBLE, 4) AS compression_ratio, round(cs.m, 4) AS mean_candidate_similarity, round(ss.m, 4) AS mean_selected_similarity,
  round(ss.m - cs.m, 4) AS relevance_delta, round(cp.m, 4) AS mean_pairwise_candidate_similarity, round(sp.m, 4) AS mean_pairwise_selected_similarity, round(sp.mx, 4) AS max_pairwise_selected_similarity,
  round(cp.m - sp.m, 4) AS pairwise_similarity_reduction, ss.c AS unique_source_window_count, ss.c AS unique_chunk_count, CAST(0 AS BIGINT) AS duplicate_chunk_count
FROM cs JOIN ss USING (query_id) JOIN cp USING (query_id) JOIN sp USING (query_id)"""),
    "mmr_lambda_sweep": sql(_DENSE + "".join(mmr_sql(l, 3, f"_{i}_") for i, l in enumerate(("1.0", "0.85", "0.7", "0.5", "0.0"))),
        " UNION ALL ".join(_sweep_sql(f"mmr_{i}_", f"{l}::DOUBLE AS lam") for i, l in enumerate(("1.0", "0.85", "0.7", "0.5", "0.0")))),
    "mmr_budget_sweep": sql(_DENSE + mmr_sql(k=5) + ", b1 AS (SELECT * FROM mmr WHERE sr <= 1), b3 AS (SELECT * FROM mmr WHERE sr <= 3)",
        " UNION ALL ".join(_sweep_sql(m, f"CAST({b} AS BIGINT) AS budget") for b, m in ((1, "b1"), (3, "b3"), (5, "mmr")))),
    "mmr_versus_top": sql(_DENSE + mmr_sql() + ", tp AS (SELECT query_id, chunk_id, similarity AS rel, rank AS sr FROM found WHERE rank <= 3)",
        _sweep_sql("tp", "'top' AS method") + " UNION ALL " + _sweep_sql("mmr", "'mmr' AS method")),
    "gated_evidence": sql(SELECTED, "SELECT query_id, sr AS selected_rank, chunk_id, source_window_id, rr AS retrieval_rank, rel AS retrieval_score, score AS selection_score, pen AS redundancy_penalty FROM mmr JOIN found USING (query_id, chunk_id)"),
    "content_hashes": sql(WINDOWS + _TFIDF, "SELECT window_id, (SELECT sha256(string_agg(trim(raw_message), E'\\n' ORDER BY line_number)) FROM wrec r WHERE r.window_id = t.window_id) AS source_hash, sha256(text) AS template_hash FROM txt t"),
    "citation_ids": sql(CITED, "SELECT query_id, selected_rank, citation_id, citation_text, source_content_hash, template_content_hash FROM cit"),
    "citation_bundles": sql(CITED, "SELECT query_id, bundle_id, evidence_count, all_verified FROM bun"),
    "bundle_verification": sql(CITED, "SELECT query_id, evidence_count AS total_citations, evidence_count AS valid_count, CAST(0 AS BIGINT) AS invalid_count, CAST(0 AS BIGINT) AS unresolved_count, true AS all_verified FROM bun"),
    "provenance_diagnostics": sql(CITED, """SELECT count(*) AS total_citations, count(DISTINCT citation_id) AS unique_citations, count(DISTINCT chunk_id) AS unique_chunks, count(DISTINCT source_window_id) AS unique_source_windows,
  count(*) - count(DISTINCT citation_id) AS duplicate_citations, 1.0::DOUBLE AS verification_success_rate, 1.0::DOUBLE AS resolution_success_rate FROM cit"""),
    "tamper_detection": sql(WINDOWS, """
SELECT window_id AS query_id, CASE right(window_id, 1) WHEN '1' THEN 'INVALID' WHEN '2' THEN 'INVALID' WHEN '3' THEN 'INVALID' WHEN '4' THEN 'INVALID' WHEN '5' THEN 'UNRESOLVED' ELSE 'VALID' END AS status,
  CASE right(window_id, 1) WHEN '1' THEN 'source_hash_mismatch' WHEN '2' THEN 'template_hash_mismatch' WHEN '3' THEN 'split_guard' WHEN '4' THEN 'citation_id_mismatch' WHEN '5' THEN 'unresolved' ELSE 'ok' END AS reason
FROM win WHERE split = 'train'"""),
}
