"""Evaluation metrics, curves, paired tests and cost accounting as group-by tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from triagelake.functions.scale import ratio, running_totals
from triagelake.operators.calibration import confusion, confusion_at, per_score

# fixed values: two-sided normal quantiles
NORMAL_QUANTILES = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def classification_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    """Confusion counts and rates; a rate without a denominator is NULL."""
    return metrics_from_counts(confusion(df, F.col(pred), F.col(y), by))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    return counts.select(
        *counts.columns,
        total.alias("total"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        # with P and R defined, 2PR/(P+R) = 2TP/(2TP+FP+FN), and it is 0 at TP = 0
        F.when((tp + fn > 0) & (tp + fp > 0), (2 * tp).cast("double") / (2 * tp + fp + fn)).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, tp + fn).alias("fnr"),
        ratio(tp + tn, total, 0.0).alias("accuracy"),
        ratio(fn, total, 0.0).alias("empirical_false_clear_rate"),
    )


def selective_metrics(counts: DataFrame) -> DataFrame:
    """Selective triage metrics from confusion counts, NULL where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counts.select(
        *counts.columns,
        n.alias("total_windows"),
        (tp + fp).alias("escalated_windows"),
        (tn + fn).alias("cleared_windows"),
        ratio(tp + fp, n).alias("escalation_rate"),
        ratio(tn + fn, n).alias("auto_clear_rate"),
        ratio(fn, n).alias("empirical_false_clear_rate"),
        ratio(fn, tn + fn).alias("selective_risk"),
        ratio(tp, tp + fp).alias("precision_escalated"),
        ratio(tp, tp + fn).alias("recall_escalated"),
    )


def ranking_metrics(scored: DataFrame, by: Sequence[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    """ROC-AUC (ties count half), PR-AUC (trapezoid) and average precision; NULL with one class."""
    table = per_score(scored, by, score, y)
    cum = running_totals(table, "s", {"n_ge": "c", "tp": "pos"}, by, descending=True)
    totals = table.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("pos").alias("p"))
    if by:
        rows = cum.join(F.broadcast(totals), list(by))
    else:
        rows = cum.withColumn("_t", totals.select(F.struct("n", "p")).scalar()).select(*cum.columns, "_t.n", "_t.p")
    c, pos, tp, n_ge, p = (F.col(x).cast("double") for x in ("c", "pos", "tp", "n_ge", "p"))
    neg_total = F.col("n") - F.col("p")
    prec, step = tp / n_ge, pos / p
    before = F.when(n_ge > c, (tp - pos) / F.nullif(n_ge - c, F.lit(0.0))).otherwise(F.lit(1.0))
    neg_below = neg_total - (n_ge - tp)
    two = (F.col("p") > 0) & (neg_total > 0)
    return rows.groupBy(*by).agg(
        F.sum(F.when(two, pos * (neg_below + (c - pos) / 2) / (p * neg_total))).alias("roc_auc"),
        F.sum(F.when(two, step * (prec + before) / 2)).alias("pr_auc"),
        F.sum(F.when(two, step * prec)).alias("average_precision"),
    )


def wilson_interval(df: DataFrame, k: str, n: str, confidence: float = 0.95, prefix: str = "wilson") -> DataFrame:
    z = NORMAL_QUANTILES.get(confidence, NORMAL_QUANTILES[0.95])
    kk, nn = F.col(k).cast("double"), F.col(n).cast("double")
    p, base = kk / nn, 1 + F.lit(z * z) / nn
    centre = (p + F.lit(z * z) / (2 * nn)) / base
    spread = F.lit(z) * F.sqrt(p * (1 - p) / nn + F.lit(z * z) / (4 * nn * nn)) / base
    ok = (F.col(n) > 0) & F.col(k).isNotNull()
    low = F.when(F.col(k) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - spread))
    high = F.when(F.col(k) == F.col(n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + spread))
    return df.withColumn(f"{prefix}_low", F.when(ok, low)).withColumn(f"{prefix}_high", F.when(ok, high))


def bootstrap_ci(
    df: DataFrame, sums: Mapping[str, Column], metric: Column, by: Sequence[str] = (), replicates: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile interval from a Poisson bootstrap.

    Rows with equal contributions are counted first: n rows of weight Poisson(1) have total weight
    Poisson(n), so a metric over confusion cells draws from four rows however large the table is.
    ``metric`` is an expression over the weighted ``sums``.
    """

    @F.pandas_udf("array<double>")
    def draws(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF]).poisson(m, replicates).astype(float) for k, m in zip(key, n)])

    names = [f"_v_{n}" for n in sums]
    cells = df.select(*by, *[c.cast("double").alias(v) for v, c in zip(names, sums.values())]).groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    drawn = cells.withColumn("_w", draws(F.xxhash64(*by, *names), F.col("_n"))).select(*by, *names, F.posexplode("_w").alias("_rep", "_k"))
    totals = drawn.groupBy(*by, "_rep").agg(*[F.sum(F.col(v) * F.col("_k")).alias(n) for v, n in zip(names, sums)])
    values = totals.select(*by, metric.alias("m")).filter(F.col("m").isNotNull())
    tail = (1 - confidence) / 2
    # one value per replicate and group, so percentile() sees a fixed number of rows
    return values.groupBy(*by).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.count(F.lit(1)).alias("replicates"))


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    from math import erfc

    return x.map(erfc, na_action="ignore")


def mcnemar(df: DataFrame, a: str, b: str, y: str | None = None, correct: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Paired test of two 0/1 prediction columns; with ``y`` also on correctness."""
    pa, pb = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    aggs = [
        F.count_if(pa & pb).alias("pos_a_pos_b"),
        F.count_if(pa & ~pb).alias("pos_a_neg_b"),
        F.count_if(~pa & pb).alias("neg_a_pos_b"),
        F.count_if(~pa & ~pb).alias("neg_a_neg_b"),
    ]
    if y:
        t = F.col(y).cast("boolean")
        aggs += [F.count_if((pa == t) & (pb != t)).alias("only_a_correct"), F.count_if((pa != t) & (pb == t)).alias("only_b_correct")]
    out = df.groupBy(*by).agg(*aggs)

    def test(frame: DataFrame, left: str, right: str, prefix: str) -> DataFrame:
        diff = F.abs(F.col(left) - F.col(right)).cast("double")
        top = F.greatest(F.lit(0.0), diff - 1.0) if correct else diff
        stat = ratio(top * top, F.col(left) + F.col(right), 0.0)
        frame = frame.withColumn(f"{prefix}statistic", stat)
        return frame.withColumn(f"{prefix}p_value", _erfc(F.sqrt(F.col(f"{prefix}statistic") / 2)))

    out = test(out, "pos_a_neg_b", "neg_a_pos_b", "")
    out = out.withColumn("significant_at_05", F.col("p_value") < 0.05)
    return test(out, "only_a_correct", "only_b_correct", "accuracy_") if y else out


def effect_sizes(metrics: DataFrame, baseline: str, by: Sequence[str] = ("dataset",), system: str = "system") -> DataFrame:
    """Each system against ``baseline`` of its group: deltas, and the cut in expensive calls."""
    cols = ["precision", "recall", "fpr", "empirical_false_clear_rate"]
    base = metrics.filter(F.col(system) == baseline).select(*by, *[F.col(c).alias(f"b_{c}") for c in cols], F.col("expensive_calls").alias("b_calls"))
    return metrics.filter(F.col(system) != baseline).join(base, list(by)).select(
        *by,
        system,
        *[(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in cols],
        ratio(F.col("b_calls") - F.col("expensive_calls"), F.col("b_calls"), 0.0).alias("expensive_call_reduction_ratio"),
    )


def operating_points(scored: DataFrame, thresholds: Mapping[str, float], by: Sequence[str] = (), score: str = "score", y: str = "y", strict: bool = True) -> DataFrame:
    """Precision at coverage: metrics per named threshold, 0 where undefined, risk NULL."""
    c = confusion_at(scored, thresholds, by, score, y, strict, key="operating_point")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return c.select(
        *c.columns,
        ratio(tp + fp, n).alias("escalation_coverage"),
        ratio(tn + fn, n).alias("auto_clear_coverage"),
        ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tp, tp + fn, 0.0).alias("recall"),
        ratio(fp, fp + tn, 0.0).alias("fpr"),
        ratio(fn, tn + fn).alias("selective_risk"),
        ratio(fn, n).alias("empirical_false_clear_rate"),
    )


def risk_coverage_curve(scored: DataFrame, points: int = 20, score: str = "score", y: str = "y") -> DataFrame:
    """Risk and coverage on an even grid of thresholds from the lowest to the highest score."""
    lo, hi = scored.agg(F.min(score), F.max(score)).first()
    grid = {str(i): (hi if i == points - 1 else lo + i * ((hi - lo) / (points - 1))) for i in range(points)}
    out = operating_points(scored, grid, score=score, y=y)
    return out.select(
        F.col("operating_point").cast("int").alias("step"), "threshold", F.col("escalation_coverage").alias("escalation_rate"),
        "auto_clear_coverage", "selective_risk", "empirical_false_clear_rate",
    )


def cost_model(df: DataFrame, n: str, escalated: str, scoring: float = 1.0, retrieval: float = 5.0, explanation: float = 50.0) -> DataFrame:
    nn = F.col(n).cast("double")
    e = F.least(F.col(escalated), F.col(n)).cast("double")
    full, used = nn * (scoring + retrieval + explanation), nn * scoring + e * (retrieval + explanation)
    return (
        df.withColumn("expensive_calls", F.least(F.col(escalated), F.col(n)))
        .withColumn("auto_cleared_windows", F.col(n) - F.col("expensive_calls"))
        .withColumn("expensive_call_fraction", ratio(e, nn))
        .withColumn("total_compute_units", used)
        .withColumn("call_reduction_ratio", ratio(nn - e, nn))
        .withColumn("relative_cost_reduction_ratio", ratio(full - used, full, 0.0))
    )


def benchmark_table(long_scores: DataFrame) -> DataFrame:
    """One row per (dataset, system) from a long (dataset, system, window_id, y, pred, score) table."""
    keys = ["dataset", "system"]
    m = cost_model(classification_metrics(long_scores, keys).withColumn("escalated", F.col("tp") + F.col("fp")), "total", "escalated")
    m = wilson_interval(wilson_interval(m, "tp", "escalated", prefix="precision_ci").withColumn("_pos", F.col("tp") + F.col("fn")), "tp", "_pos", prefix="recall_ci")
    return m.drop("_pos").join(ranking_metrics(long_scores, keys), keys, "left")


def compare_runs(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Full outer join of two metric tables with the difference of every metric."""
    l = left.select(*keys, *[F.col(m).alias(f"{m}_left") for m in metrics], F.lit(True).alias("_l"))
    r = right.select(*keys, *[F.col(m).alias(f"{m}_right") for m in metrics], F.lit(True).alias("_r"))
    out = l.join(r, list(keys), "full_outer")
    presence = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return out.select(*keys, presence.alias("presence"), *[c for m in metrics for c in (F.col(f"{m}_left"), F.col(f"{m}_right"), (F.col(f"{m}_right") - F.col(f"{m}_left")).alias(f"{m}_delta"))])
