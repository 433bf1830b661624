import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import calibration as cal
from triagelake.operators import evaluation as ev
from triagelake.operators import monitoring as mon
from triagelake.operators import scorers, windows


def seqs(spark, items):
    return spark.createDataFrame([("d", w, t) for w, t in items], "dataset string, window_id string, template_ids array<int>")


TRAIN = [(f"t{i:02d}", [1, 2, 1, 3]) for i in range(20)] + [("t20", [4, 4, 1])]
CALIB = [(f"c{i}", [1, 2, 1, 3]) for i in range(8)] + [("c8", [99, -1, 4]), ("c9", [4, 4, 4, 4])]


def scores(spark, values, y=None):
    y = y or [0] * len(values)
    return spark.createDataFrame([(f"w{i}", float(v), int(t)) for i, (v, t) in enumerate(zip(values, y))], "window_id string, score double, y int")


def test_frequency_score_by_hand(spark):
    fit = scorers.fit_frequency(windows.sequence_counts(seqs(spark, TRAIN)))
    p = {r["template_id"]: math.exp(r["log_p"]) for r in fit.collect()}
    assert p[1] == pytest.approx(42 / 88) and p[4] == pytest.approx(3 / 88) and p[-1] == pytest.approx(1 / 88)
    assert sum(p.values()) == pytest.approx(1.0)
    s = {r["window_id"]: r["score"] for r in scorers.frequency_scores(windows.sequence_counts(seqs(spark, CALIB)), fit).collect()}
    assert s["c8"] == pytest.approx((2 * math.log(88) + math.log(88 / 3)) / 3) and s["c8"] > s["c0"]


def test_tokens_and_next_template(spark):
    vocab = scorers.vocabulary(windows.sequence_counts(seqs(spark, TRAIN)), 2)
    assert {r["template_id"]: r["idx"] for r in vocab.collect()} == {1: 2, 2: 3, 3: 4, 4: 5}
    enc = scorers.encode_sequences(seqs(spark, CALIB + [("one", [1])]), vocab, 3)
    got = {r["window_id"]: r["tokens"] for r in enc.collect()}
    assert got["c8"] == [1, 1, 5] and got["c0"] == [2, 3, 2]
    model = scorers.fit_next_template(scorers.encode_sequences(seqs(spark, TRAIN), vocab), 5)
    s = {r["window_id"]: r["score"] for r in scorers.next_template_scores(enc, model).collect()}
    assert s["c8"] > s["c0"] > 0 and s["one"] > 0


def test_pca_matches_numpy_and_forest_ranks_outliers(spark):
    items = [(f"n{i}", [1, 2, 1, 3] if i % 2 else [1, 1, 2, 3, 3]) for i in range(40)] + [("x", [4, 4, 4, 4])]
    train = seqs(spark, items[:40] + [("r", [4, 1, 2])])
    vocab = scorers.vocabulary(windows.sequence_counts(train))
    f = scorers.count_vectors(windows.sequence_counts(train), vocab)
    d = 5
    fit = scorers.fit_pca(f, d)
    x = np.zeros((41, d))
    order = {}
    for r in f.collect():
        x[order.setdefault(r["window_id"], len(order)), r["idx"]] = r["value"]
    c = x - x.mean(0)
    u, sv, vt = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(sv**2 / (sv**2).sum()), 0.95) + 1)
    assert fit["k"] == k
    want = ((c - c @ vt[:k].T @ vt[:k]) ** 2).sum(1)
    got = {r["window_id"]: r["score"] for r in scorers.pca_scores(f, d, fit).collect()}
    assert all(got[w] == pytest.approx(want[i], abs=1e-9) for w, i in order.items())
    probe = scorers.count_vectors(windows.sequence_counts(seqs(spark, items)), vocab)
    forest = scorers.fit_isolation_forest(f, d, trees=25)
    s = {r["window_id"]: r["score"] for r in scorers.isolation_scores(probe, d, forest).collect()}
    assert max(s, key=s.get) == "x" and all(0 < v < 1 for v in s.values())


@pytest.mark.parametrize("values", [list(range(1, 21)), [1, 1, 2, 2, 2, 3, 3, 9], [5] * 7, [4]])
@pytest.mark.parametrize("alpha", [0.05, 0.10, 0.20, 0.50])
def test_conformal_threshold(spark, values, alpha):
    n = len(values)
    k = min(n, max(1, math.ceil((n + 1) * (1.0 - alpha))))
    assert cal.threshold_map(scores(spark, values), [alpha])[alpha] == sorted(values)[k - 1]


def test_p_values_and_gate_agree(spark):
    c = scores(spark, range(1, 21))
    q = scores(spark, [0, 1, 5.5, 20, 21])
    got = {r["score"]: r["p_value"] for r in cal.conformal_p_values(c, q).collect()}
    assert got == {s: pytest.approx((1 + sum(v >= s for v in range(1, 21))) / 21) for s in (0, 1, 5.5, 20, 21)}
    t = cal.threshold_map(c, [0.1])[0.1]
    assert all((s > t) == (p <= 0.1) for s, p in got.items())


def test_quantiles_match_numpy(spark):
    v = list(np.random.default_rng(1).normal(size=101).round(1))
    row = cal.quantiles(scores(spark, v), {"a": 0.05, "b": 0.5, "c": 0.987}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.987])))


def test_oracle_threshold_brute_force(spark):
    rng = np.random.default_rng(2)
    for n in (30, 400):
        v, y = rng.normal(size=n).round(3), (rng.random(n) < 0.2).astype(int)
        best = (-1.0, 0.0)
        for t in np.unique(v):
            tp, fp = int(((v > t) & (y == 1)).sum()), int(((v > t) & (y == 0)).sum())
            f1 = 2 * tp / (2 * tp + fp + int(y.sum()) - tp)
            if f1 > best[0]:
                best = (f1, t)
        row = cal.oracle_threshold(scores(spark, v, list(y))).first()
        assert row["f1"] == pytest.approx(best[0]) and row["threshold"] == pytest.approx(best[1])


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, y int")
    m = ev.classification_metrics(df).first()
    assert m["precision"] is None and m["recall"] is None and m["f1"] is None and m["fpr"] == 0.0
    assert ev.ranking_metrics(scores(spark, [1, 2])).first()["roc_auc"] is None
    w = ev.wilson_interval(spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int"), "k", "n").collect()
    assert w[0]["wilson_low"] == 0.0 and w[1]["wilson_high"] == 1.0 and w[2]["wilson_low"] is None


def test_mcnemar_and_bootstrap(spark):
    df = spark.createDataFrame([(1, 0, 1)] * 12 + [(0, 1, 1)] * 3 + [(1, 1, 1)] * 5, "a int, b int, y int")
    m = ev.mcnemar(df, "a", "b", "y").first()
    assert m["statistic"] == pytest.approx(64 / 15) and m["p_value"] == pytest.approx(math.erfc(math.sqrt(64 / 30)))
    ci = ev.bootstrap_ci(df, {"s": F.col("a"), "n": F.lit(1)}, F.try_divide("s", "n")).first()
    assert ci["low"] < 17 / 20 < ci["high"] and 0.6 < ci["low"] and ci["high"] <= 1.0


def test_drift(spark):
    rng = np.random.default_rng(3)
    ref = scores(spark, rng.normal(1, 0.2, 400))
    assert mon.drift_verdict(ref, ref).first()["drift_status"] == "STABLE"
    assert mon.drift_verdict(ref, scores(spark, rng.normal(2, 0.2, 100))).first()["drift_status"] == "DRIFT DETECTED"
    assert mon.drift_verdict(ref, scores(spark, [1.0] * 5)).first()["drift_status"] == "INSUFFICIENT DATA"


def test_reviews_last_wins(spark):
    r = spark.createDataFrame([("i", "r", "E", "REJECT", "x", 1), ("i", "r", "E", "CONFIRM", None, 2), ("j", "r", "E", "BAD", None, 3)], "incident_id string, reviewer_id string, machine_decision string, human_decision string, reason string, ts int")
    (row,) = mon.latest_reviews(r).collect()
    assert row["human_decision"] == "CONFIRM" and row["reason"] == "Agreed with machine triage"
    assert mon.review_summary(mon.latest_reviews(r)).first()["human_agreement_rate"] == 1.0
