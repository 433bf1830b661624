"""Thresholds, split-conformal gate and selective-prediction metrics.

Scores are first collapsed to distinct values with counts; every order statistic, curve and
p-value is a running sum over that table (see ``running_totals``), never a sorted array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, order_positions, ratio, running_totals

ALPHA_GRID = (0.01, 0.05, 0.10, 0.20)
QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def per_score(scores: DataFrame, by: Sequence[str] = (), score: str = "score", y: str | None = None) -> DataFrame:
    """Distinct scores with row count ``c`` and, given ``y``, positive count ``pos``."""
    aggs = [F.count(F.lit(1)).alias("c")]
    if y:
        aggs.append(F.count_if(F.col(y).cast("boolean")).alias("pos"))
    return scores.groupBy(*by, F.col(score).alias("s")).agg(*aggs)


def order_values(scores: DataFrame, ranks: Mapping[str, Column], by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Values at 0-based ranks, one column each. Ranks are expressions over ``_n``, the row count.

    Each distinct score keeps the ranks that fall on its run of equal rows, so at most one row per
    rank and group leaves the scan of the score table.
    """
    cum = running_totals(per_score(scores, by, score), "s", {"upto": "c"}, by)
    sizes = cum.groupBy(*by).agg(F.sum("c").alias("_n"))
    joined = cum.join(F.broadcast(sizes), list(by)) if by else cum.withColumn("_n", sizes.scalar())
    wanted = F.array(*[r.cast("long") for r in ranks.values()])
    here = F.filter(F.transform(wanted, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: (x["r"] < F.col("upto")) & (x["r"] >= F.col("upto") - F.col("c")))
    hits = joined.select(*by, "_n", "s", F.explode(here.getField("i")).alias("i"))
    found = hits.groupBy(*by).agg(F.first("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("_m"))
    return found.select(*by, "n", *[F.element_at("_m", F.lit(i)).alias(name) for i, name in enumerate(ranks)])


def quantiles(scores: DataFrame, qs: Mapping[str, float], by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, any table size."""
    ranks = {}
    for name, q in qs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(at), F.ceil(at)
    out = order_values(scores, ranks, by, score)
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return out.select(*by, "n", *qs)


def quantile_threshold(scores: DataFrame, q: float = 0.95, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    if not 0.0 < q < 1.0:
        raise ValueError("quantile must lie in (0, 1)")
    return quantiles(scores, {"threshold": q}, by, score)


def conformal_thresholds(calib: DataFrame, alphas: Sequence[float] = ALPHA_GRID, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """One row per alpha: the ceil((n+1)(1-alpha))-th smallest calibration score, rank in 1..n."""
    for a in alphas:
        if not 0.0 < a < 1.0:
            raise ValueError("alpha must lie in (0, 1)")
    rank = [F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil((F.col("_n") + 1) * F.lit(1.0 - a)))) - 1 for a in alphas]
    wide = order_values(calib, {f"a{i}": r for i, r in enumerate(rank)}, by, score)
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("threshold")) for i, a in enumerate(alphas)])
    return wide.select(*by, F.col("n").alias("n_calibration"), F.inline(rows)).filter(F.col("threshold").isNotNull())


def threshold_map(calib: DataFrame, alphas: Sequence[float] = ALPHA_GRID, score: str = "score") -> dict[float, float]:
    """The thresholds as plain numbers, one per alpha."""
    found = {r["alpha"]: r["threshold"] for r in conformal_thresholds(calib, alphas, score=score).collect()}
    if not found:
        raise ValueError("cannot calibrate on an empty score table")
    return found


def conformal_p_values(calib: DataFrame, queries: DataFrame, score: str = "score") -> DataFrame:
    """(1 + #{calibration >= s}) / (n + 1) for each query score; a range count without a range join."""
    both = calib.select(F.col(score).alias("s"), F.lit(1).alias("c")).unionByName(queries.select(F.col(score).alias("s"), F.lit(0).alias("c")))
    table = both.groupBy("s").agg(F.sum("c").alias("c"))
    tail = running_totals(table, "s", {"at_least": "c"}, descending=True)
    n = calib.agg(F.count(F.lit(1))).scalar()
    p = tail.select("s", ((F.lit(1.0) + F.col("at_least")) / (n + 1)).alias("p_value"))
    return queries.join(p, queries[score] == p["s"], "left").drop("s")


def calibrator_metadata(calib: DataFrame, score: str = "score") -> DataFrame:
    base = calib.agg(F.count(F.lit(1)).alias("n_calibration"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))
    return base.withColumn("median_score", quantiles(calib, {"m": 0.5}, score=score).select("m").scalar())


def gate(scored: DataFrame, threshold: float | Column, strict: bool = True, score: str = "score") -> DataFrame:
    """ESCALATE above the threshold (or at it, if not strict), else AUTO-CLEAR."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    over = F.col(score) > t if strict else F.col(score) >= t
    return scored.withColumn("decision", F.when(over, "ESCALATE").otherwise("AUTO-CLEAR"))


def confusion(df: DataFrame, pred: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    p, t = pred.cast("boolean"), y.cast("boolean")
    return df.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn")
    )


def confusion_at(
    df: DataFrame, thresholds: Mapping[str, float], by: Sequence[str] = (), score: str = "score", y: str = "y", strict: bool = True, key: str = "point"
) -> DataFrame:
    """Confusion counts at several thresholds in one pass, without multiplying the rows."""
    s, t = F.col(score), F.col(y).cast("boolean")
    aggs = []
    for i, th in enumerate(thresholds.values()):
        p = s > F.lit(float(th)) if strict else s >= F.lit(float(th))
        aggs += [F.count_if(p & t).alias(f"tp{i}"), F.count_if(p & ~t).alias(f"fp{i}"), F.count_if(~p & ~t).alias(f"tn{i}"), F.count_if(~p & t).alias(f"fn{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias(key), F.lit(float(th)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")])
            for i, (name, th) in enumerate(thresholds.items())
        ]
    )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def selective_performance(counts: DataFrame, alpha: Column | None = None) -> DataFrame:
    """Selective-prediction metrics from confusion counts; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    esc, clear, n = tp + fp, tn + fn, tp + fp + tn + fn
    p, r = ratio(tp, esc, 0.0), ratio(tp, tp + fn, 0.0)
    out = counts.select(
        *counts.columns,
        n.alias("total_windows"),
        (tp + fn).alias("total_anomalies"),
        esc.alias("n_escalated"),
        clear.alias("n_cleared"),
        ratio(esc, n, 0.0).alias("escalation_rate"),
        ratio(clear, n, 0.0).alias("coverage"),
        p.alias("escalation_precision"),
        r.alias("escalation_recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("escalation_f1"),
        ratio(fn, clear, 0.0).alias("selective_risk"),
        ratio(fn, n, 0.0).alias("empirical_false_clear_rate"),
    )
    return out if alpha is None else out.withColumn("deviation_from_nominal", F.col("empirical_false_clear_rate") - alpha)


def alpha_sweep(scored: DataFrame, thresholds: Mapping[float, float], by: Sequence[str] = (), score: str = "score", y: str = "y", strict: bool = True) -> DataFrame:
    named = {str(a): t for a, t in thresholds.items()}
    counts = confusion_at(scored, named, by, score, y, strict, key="alpha").withColumn("alpha", F.col("alpha").cast("double"))
    return selective_performance(counts, F.col("alpha"))


def score_stats(scored: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Count, range, mean, population deviation and quantiles; ``by`` may be empty."""
    q = quantiles(scored, QUANTILES, by, score).drop("n")
    base = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")
    )
    if by:
        return base.join(q, list(by))
    row = q.select(F.struct(*QUANTILES)).scalar()
    return base.withColumn("_q", row).select(*base.columns, "_q.*")


def score_distribution(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """``score_stats`` for all, normal and anomalous rows as one long table."""
    label = F.when(F.col(y).cast("boolean"), F.lit("anomalous")).otherwise(F.lit("normal"))
    parts = scored.withColumn("part", F.explode(F.array(F.lit("all"), label)))
    return score_stats(parts, ["part"], score)


def oracle_threshold(scored: DataFrame, score: str = "score", y: str = "y", strict: bool = True) -> DataFrame:
    """Threshold with the best F1 (diagnosis only) over all distinct scores; the lowest of equals.

    Running sums from the highest score down give the counts of every threshold in one pass.
    """
    table = per_score(scored, score=score, y=y)
    cum = running_totals(table, "s", {"up_c": "c", "up_pos": "pos"}, descending=True)
    tp = F.col("up_pos") - F.col("pos") if strict else F.col("up_pos")
    flagged = F.col("up_c") - F.col("c") if strict else F.col("up_c")
    positives = table.agg(F.coalesce(F.sum("pos"), F.lit(0))).scalar()
    p, r = ratio(tp, flagged, 0.0), ratio(tp, positives, 0.0)
    f1 = ratio(2 * tp, flagged + positives, 0.0)
    rows = cum.select(F.col("s").cast("double").alias("threshold"), f1.alias("f1"), p.alias("precision"), r.alias("recall"), positives.alias("positives"))
    best = rows.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold"))).alias("b"), F.max("threshold").alias("top"), F.max("positives").alias("pos"))
    none = F.col("pos") == 0
    return best.filter(F.col("top").isNotNull()).select(
        F.when(none, F.col("top")).otherwise(F.col("b.threshold")).alias("threshold"),
        *[F.when(none, F.lit(0.0)).otherwise(F.col(f"b.{c}")).alias(c) for c in ("f1", "precision", "recall")],
    )


def error_analysis(scored: DataFrame, threshold: float, k: int = 5, score: str = "score", y: str = "y", strict: bool = True) -> DataFrame:
    """Top-k highest scores, false positives (highest) and false negatives (lowest), with templates."""
    over = F.col(score) > threshold if strict else F.col(score) >= threshold
    base = scored.withColumn("predicted", over).withColumn("label", F.col(y).cast("boolean"))

    def top(kind: str, cond: Column, order: Column) -> DataFrame:
        return base.filter(cond).orderBy(order, "window_id").limit(k).withColumn("kind", F.lit(kind))

    parts = [
        top("highest", F.lit(True), F.desc(score)),
        top("false_positive", F.col("predicted") & ~F.col("label"), F.desc(score)),
        top("false_negative", ~F.col("predicted") & F.col("label"), F.asc(score)),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(
        "kind", "window_id", F.col(score).alias("score"), "label", "predicted", "record_count",
        F.array_sort(F.array_distinct("template_ids")).alias("unique_templates"),
    )


def calibration_size_sensitivity(calib: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 1.0), alpha: float = 0.05, min_rows: int = 5) -> DataFrame:
    """Threshold and metrics on chronological prefixes of the calibration split.

    A prefix holds the first n windows by start time and then line, so ties of time don't swell it.
    """
    n = calib.count()
    sizes = {f: min(n, max(min_rows, int(n * f))) for f in fractions}
    placed = materialize(order_positions(calib.withColumn("_t", F.coalesce("start_time", F.lit(float("inf")))), "_t", "first_line", out="_pos"), "calibration-order")
    out = None
    for f, s in sizes.items():
        sub = placed.filter(F.col("_pos") < s)
        t = threshold_map(sub, [alpha])[alpha]
        row = alpha_sweep(sub, {alpha: t}).select(F.lit(f).alias("fraction"), F.lit(s).alias("sample_size"), "threshold", "escalation_rate", "coverage", "selective_risk", "empirical_false_clear_rate", "deviation_from_nominal")
        out = row if out is None else out.unionByName(row)
    return out
