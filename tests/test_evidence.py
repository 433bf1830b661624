import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import claims as cl
from triagelake.operators import provenance as prov
from triagelake.operators import reasoning as rs
from triagelake.operators import retrieval as ret
from triagelake.operators import selection as sel


def windows(spark):
    rows = [("d", "train", f"w{i:02d}", None, float(i), float(i), 3, [1, 2, 3], [f" m{i} ", "x"], False, i * 3 + 1, i * 3 + 3) for i in range(10)]
    rows += [("d", "train", f"w{i:02d}", None, float(i), float(i), 3, [4, 5, 6] if i % 2 else [4, 4, 9], [f"m{i}"], True, i * 3 + 1, i * 3 + 3) for i in range(10, 15)]
    return spark.createDataFrame(rows, "dataset string, split string, window_id string, session_id string, start_time double, end_time double, record_count long, template_ids array<int>, raw_messages array<string>, is_anomaly boolean, first_line long, last_line long")


def test_top_k_against_brute_force(spark):
    corpus = ret.build_corpus(windows(spark))
    idf = ret.fit_idf(corpus)
    q = spark.createDataFrame([("d", "w03", 3, [1, 2, 3]), ("d", "q1", 3, [4, 5, 1]), ("d", "q2", 2, [77, 88]), ("d", "q3", 2, [1, 1, 2, 2, 3, 3])], "dataset string, window_id string, record_count int, template_ids array<int>")
    got = {}
    for r in ret.top_k(ret.build_queries(q), corpus, idf, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["similarity"], r["chunk_id"]))
    weight = {r["token"]: r["idf"] for r in idf.collect()}

    def vec(ids):
        v = {}
        for i in ids:
            t = f"template_{i}"
            if t in weight:
                v[t] = v.get(t, 0) + weight[t]
        n = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()} if n else {}

    chunks = corpus.collect()
    for r in q.collect():
        a = vec(r["template_ids"])
        want = sorted(
            ((-round(sum(a.get(t, 0) * x for t, x in vec(c["template_ids"]).items()), 6), c["chunk_id"]) for c in chunks if c["source_window_id"] != r["window_id"])
        )[:5]
        assert [(pytest.approx(-s), c) for s, c in want] == got[r["window_id"]]
    assert ret.top_k(ret.build_queries(q), corpus, idf, 0).count() == 0


def test_mmr_by_hand(spark):
    rows = [(1, 0.95, "chunk_a", "win_1", [1, 0, 0, 0]), (2, 0.90, "chunk_b", "win_1", [1, 0, 0, 0]), (3, 0.80, "chunk_c", "win_2", [0, 1, 0, 0]), (4, 0.75, "chunk_d", "win_3", [0, 0, 1, 0]), (5, 0.40, "chunk_e", "win_4", [0, 0, 0, 1])]
    c = spark.createDataFrame([("d", "q", r, s, ch, w, [float(x) for x in v]) for r, s, ch, w, v in rows], "dataset string, query_id string, rank int, similarity double, chunk_id string, source_window_id string, vec array<double>")
    sets = sel.candidate_sets(c)
    p = sel.mmr_picks(sets, 3, 0.7, 5)
    got = [(r["chunk_id"], r["selection_score"]) for r in sel.selected_rows(p).orderBy("selected_rank").collect()]
    assert got == [("chunk_a", 0.95), ("chunk_c", pytest.approx(0.56)), ("chunk_d", pytest.approx(0.525))]
    m = sel.selection_metrics(p, 5).first()
    assert m["compression_ratio"] == 0.6 and m["mean_pairwise_candidate_similarity"] == 0.1 and m["duplicate_chunk_count"] == 0
    assert sel.selected_rows(sel.mmr_picks(sets, 9)).count() == 5
    with pytest.raises(ValueError):
        sel.mmr_picks(sets, 6, 0.7, 5)


def cited(spark):
    w = windows(spark)
    s = ret.build_corpus(w).limit(1).select("dataset", F.lit("q").alias("query_id"), "chunk_id", "source_window_id", F.lit(1).alias("selected_rank"), F.lit(0.9).alias("retrieval_score"), F.lit(0.9).alias("selection_score"))
    return w, prov.create_citations(s, w, "artifact")


def test_citations_verify_and_tamper(spark):
    w, c = cited(spark)

    def reason(citations, table=w, artifact="artifact"):
        return prov.verify_citations(citations, table, artifact).first()["reason"]

    assert reason(c) == "ok"
    assert reason(c, w.withColumn("raw_messages", F.array(F.lit("changed")))) == "source_hash_mismatch"
    assert reason(c, w.withColumn("template_ids", F.array(F.lit(1)))) == "template_hash_mismatch"
    assert reason(c, w.limit(0)) == "unresolved"
    assert reason(c, w, "other") == "artifact_mismatch"
    assert reason(c.withColumn("split", F.lit("test"))) == "split_guard"
    assert reason(c.withColumn("citation_text", F.lit("Label: normal"))) == "label_guard"
    assert reason(c.withColumn("citation_id", F.reverse("citation_id"))) == "citation_id_mismatch"


def incident(spark, score=1.5, b0=1.5, decision="ESCALATE", sims=(0.9, 0.85), unknown=False, verified=True):
    w, c = cited(spark)
    base = prov.verify_citations(c, w, "artifact").first()
    item = F.struct(*[F.lit(base[k]).alias(k) for k in ("citation_id", "citation_text", "chunk_id", "source_window_id", "source_content_hash", "template_content_hash", "status")],
                    F.struct(F.lit(base["source_location"]["line_start"]).alias("line_start"), F.lit(base["source_location"]["line_end"]).alias("line_end"), F.lit(3).alias("record_count")).alias("source_location"))
    arr = F.array(*[item.withField("selected_rank", F.lit(i + 1)).withField("retrieval_score", F.lit(s)).withField("selection_score", F.lit(s)) for i, s in enumerate(sims)])
    if not sims:
        arr = F.slice(F.array(item.withField("selected_rank", F.lit(1)).withField("retrieval_score", F.lit(0.0)).withField("selection_score", F.lit(0.0))), 1, 0)
    return spark.range(1).select(
        F.lit("d").alias("dataset"), F.lit("calibration").alias("split"), F.lit("w").alias("window_id"), F.lit(14).alias("record_count"), F.lit(3).alias("unique_templates"), F.lit(unknown).alias("has_unknown_template"),
        F.lit(1226243162.0).alias("start_time"), F.lit(1226243445.0).alias("end_time"), F.lit(score).alias("anomaly_score"), F.lit(b0).alias("b0_score"), F.lit(decision).alias("decision"),
        arr.alias("citations"), F.lit("d").alias("bundle_dataset"), F.lit("train").alias("bundle_split"), F.lit(verified).alias("all_verified"))


@pytest.mark.parametrize(
    "kw, decision, severity, rule",
    [
        ({}, "INCIDENT", "HIGH", "RULE-INC-001"),
        ({"unknown": True}, "INCIDENT", "CRITICAL", "RULE-INC-001"),
        ({"score": 0.8}, "SUSPICIOUS", "LOW", "RULE-SUSP-001"),
        ({"sims": (0.6, 0.6)}, "SUSPICIOUS", "MEDIUM", "RULE-CONF-001"),
        ({"sims": (0.1, 0.1)}, "INSUFFICIENT_EVIDENCE", "LOW", "RULE-SUFF-001"),
        ({"sims": ()}, "INSUFFICIENT_EVIDENCE", "LOW", "RULE-SUFF-001"),
        ({"verified": False}, "INSUFFICIENT_EVIDENCE", "LOW", "RULE-PROV-001"),
        ({"decision": "AUTO-CLEAR"}, "NORMAL", "LOW", "RULE-NORM-001"),
    ],
)
def test_decisions(spark, kw, decision, severity, rule):
    r = rs.assess(incident(spark, **kw)).first()
    assert (r["final_decision"], r["severity"], r["rule_fired"]) == (decision, severity, rule)
    assert 0.05 <= r["confidence"] <= 0.98


def test_confidence_by_hand(spark):
    r = rs.assess(incident(spark)).first()
    assert r["confidence"] == pytest.approx(0.3 + 0.3 * 0.875 + 0.2 + 0.2) and r["agreement_level"] == "HIGH"
    r = rs.assess(incident(spark, b0=0.5)).first()
    assert [c["conflict_id"] for c in r["conflicts"]] == ["CONF-002"] and r["agreement_score"] == 0.8


def explained(spark, raw, decision="INCIDENT"):
    w, c = cited(spark)
    row = c.first()
    cites = F.array(F.struct(F.lit("cid").alias("citation_id"), F.lit(row["citation_text"]).alias("citation_text"), F.lit(1).alias("selected_rank"), F.lit(0.9).alias("retrieval_score"), F.lit(0.8).alias("selection_score"),
                             F.struct(F.lit(100).alias("line_start"), F.lit(150).alias("line_end"), F.lit(15).alias("record_count")).alias("source_location")))
    df = spark.createDataFrame([("d", "calibration", "w1", raw, decision, "HIGH", 0.5)], "dataset string, split string, window_id string, raw_json string, final_decision string, severity string, confidence double")
    df = df.withColumn("citations", cites).withColumn("all_verified", F.lit(True)).withColumn("provenance_ok", F.lit(True)).withColumn("provenance_reason", F.lit("VERIFIED"))
    df = df.withColumn("trusted", cl.trusted_numbers(F.col("confidence"), F.array(F.lit(1.5)), F.col("citations")))
    return cl.assemble(cl.validate(cl.check_faithfulness(cl.check_citations(cl.parse_claims(df))))).first()


def body(claims, decision="INCIDENT", severity="HIGH", summary="ok"):
    return '{"incident_decision": "%s", "severity": "%s", "summary": "%s", "claims": %s}' % (decision, severity, summary, claims)


@pytest.mark.parametrize(
    "raw, reasons",
    [
        (body('[{"text": "anomaly score 1.5 on lines 100", "claim_type": "OBSERVATION", "citation_ids": ["cid"]}]'), []),
        (body('[{"text": "anomaly score", "claim_type": "OBSERVATION", "citation_ids": "cid"}]'), []),
        ("not json", ["json_parse"]),
        (body("[]", decision="NORMAL"), ["decision_immutability"]),
        (body("[]", severity="LOW"), ["severity_immutability"]),
        (body('[{"text": "anomaly score", "claim_type": "EVIDENCE", "citation_ids": ["nope"]}]'), ["citation_validation", "coverage_check"]),
        (body('[{"text": "anomaly score 777.5", "claim_type": "OBSERVATION", "citation_ids": ["cid"]}]'), ["numeric_check"]),
        (body('[{"text": "anomaly score", "claim_type": "OBSERVATION", "citation_ids": []}]'), ["coverage_check"]),
        (body("[]", summary="The disk corrupted itself"), ["freeform_text_inspection"]),
    ],
)
def test_explanation_cases(spark, raw, reasons):
    r = explained(spark, raw)
    assert r["reasons"] == reasons
    assert r["explanation_status"] == ("VALIDATION_FAILED" if reasons else "GENERATED")


def test_contradiction_and_types(spark):
    raw = body('[{"text": "a confirmed incident caused by anomaly", "claim_type": "guess"}]', decision="INSUFFICIENT_EVIDENCE")
    r = explained(spark, raw, "INSUFFICIENT_EVIDENCE")
    assert r["faithfulness_status"] == "INVALID" and "contradiction_check" in r["reasons"]
    assert r["claims"][0]["claim_type"] == "INTERPRETATION" and r["claims"][0]["claim_id"] == "CLM-w1-001" and len(r["claims"][0]["notes"]) == 1


def test_document_frequencies_count_a_key_once(spark):
    texts = [(1, "a b a"), (1, "b c"), (2, " a\tA "), (None, "c"), (None, "c d"), (3, None), (4, ""), (5, "d")]
    rows = spark.createDataFrame([("x", k, t) for k, t in texts], "dataset string, doc_id long, text string")
    got = {r["token"]: r["df"] for r in ret.document_frequencies(rows, "doc_id").collect()}
    plain = {r["token"]: r["df"] for r in ret.fit_idf(rows, "doc_id").collect()}
    assert got == plain == {"a": 2, "b": 1, "c": 2, "d": 2}
    once = rows.filter("doc_id IN (2, 3, 4, 5)")
    frequencies = ret.document_frequencies(once, "doc_id")
    assert {r["token"]: r["df"] for r in frequencies.collect()} == {"a": 1, "d": 1}
    # the rows between the tasks are tokens of a task, not tokens of a document
    many = spark.range(400).selectExpr("'x' AS dataset", "id AS doc_id", "'p q r s' AS text").repartition(2)
    writes = []
    plans = ret.materialize
    ret.materialize = lambda df, name: writes.append(df) or plans(df, name)
    try:
        assert ret.document_frequencies(many, "doc_id").count() == 4
    finally:
        ret.materialize = plans
    assert "doc_id" not in writes[-1]._jdf.queryExecution().executedPlan().toString().split("Exchange")[1]
