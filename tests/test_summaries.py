"""Summaries of retrieval, reasoning, explanations, calls and data quality on rows counted by hand."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import claims, reasoning, retrieval, splits


def test_retrieval_spread(spark):
    gated = spark.createDataFrame([("q1", "ESCALATE"), ("q2", "ESCALATE"), ("q3", "AUTO-CLEAR"), ("q4", "AUTO-CLEAR")], "window_id string, decision string")
    ev = spark.createDataFrame([("q1", "c1", "w1", 0.2), ("q1", "c2", "w2", 0.4), ("q2", "c1", "w1", 0.8), ("q2", "c2", "q2", 1.0)], "query_id string, chunk_id string, source_window_id string, similarity double")
    corpus = spark.createDataFrame([("d", "c1", "a b"), ("d", "c2", "a a"), ("d", "c3", "none"), ("d", "c4", None)], "dataset string, chunk_id string, text string")
    idf = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "token string, idf double")
    r = retrieval.retrieval_spread(gated, ev, corpus, idf).first()
    assert (r.total_windows, r.auto_clear_count, r.auto_clear_rate, r.self_retrieval_rate, r.zero_vector_count) == (4, 2, 0.5, 0.25, 2)
    assert [r.sim_p25, r.sim_median, r.sim_p75] == pytest.approx([0.35, 0.6, 0.85]) and r.mean_vector_norm == pytest.approx(0.5)
    r = retrieval.retrieval_spread(gated.limit(0), ev.limit(0), corpus.limit(0), idf).first()
    assert r.asDict() == {"total_windows": 0, "auto_clear_count": 0, "auto_clear_rate": 0.0, "sim_p25": None, "sim_median": None, "sim_p75": None,
                          "self_retrieval_rate": 0.0, "zero_vector_count": 0, "mean_vector_norm": 0.0}


def test_reasoning_averages(spark):
    rows = spark.createDataFrame([(["x", "y"], 3, 0.5, 0.9), ([], 0, 0.0, 0.95), (["x"], 1, 0.25, 0.4)], "conflicts array<string>, evidence_count int, mean_relevance double, confidence double")
    assert tuple(reasoning.reasoning_averages(rows).first()) == (3, 3, 0.6667, 1.3333, 0.25, 0.75)
    assert tuple(reasoning.reasoning_averages(rows.limit(0)).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_outcomes_and_usage(spark):
    final = spark.createDataFrame([("GENERATED", "VERIFIED"), ("GENERATED", "UNSUPPORTED"), ("ABSTAINED", None)], "explanation_status string, faithfulness_status string")
    got = {(r.measure, r.key): r.n for r in claims.explanation_outcomes(final).collect()}
    assert got == {("status", "GENERATED"): 2, ("status", "ABSTAINED"): 1, ("faithfulness", "VERIFIED"): 1, ("faithfulness", "UNSUPPORTED"): 1, ("faithfulness", None): 1}
    calls = spark.createDataFrame([(10.0, 5, 7, 0), (20.0, 3, None, 2), (None, None, None, None)], "latency_ms double, input_tokens long, output_tokens long, retry_count long")
    assert claims.usage_totals(calls).first().asDict() == {"measured_calls": 2, "mean_latency_ms": 15.0, "total_input_tokens": 8, "total_output_tokens": 7, "total_retries": 2, "total_tokens": 15}
    assert claims.usage_totals(calls.limit(0)).first().total_tokens == 0


def test_quality_details(spark):
    windows = spark.createDataFrame([("w1", "train"), ("w2", "calibration"), ("w3", "test")], "window_id string, split string")
    records = spark.createDataFrame([("train", 1), ("train", 1), ("train", 2), ("train", -1), ("test", 1), ("test", 9), ("calibration", 9), ("test", -1), ("test", None)], "split string, template_id int")
    # a null template is in no vocabulary and not counted
    assert tuple(splits.quality_details(windows, records).first()) == (True, 2, 2)
    leaky = windows.union(windows.withColumn("split", F.lit("test")))
    assert tuple(splits.quality_details(leaky, records.limit(0)).first()) == (False, 0, 0)
