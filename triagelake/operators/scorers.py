"""Anomaly scorers over windows. Fitted state comes from TRAIN and is itself a small table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import pin_small, running_totals
from triagelake.operators import pca

UNKNOWN_TEMPLATE = -1
PAD_TOKEN = 0
UNKNOWN_TOKEN = 1
MAX_PCA_FEATURES = 4_000


def vocabulary(train_counts: DataFrame, first_index: int = 0) -> DataFrame:
    """(template_id, idx) of the known TRAIN templates, in id order from ``first_index``."""
    known = train_counts.filter(F.col("template_id") != UNKNOWN_TEMPLATE).select("template_id").distinct().withColumn("one", F.lit(1))
    ranked = running_totals(known, "template_id", {"rank": "one"})
    return pin_small(ranked.select("template_id", (F.col("rank") - 1 + first_index).cast("int").alias("idx")))


def count_vectors(counts: DataFrame, vocab: DataFrame, mode: str = "normalized_count") -> DataFrame:
    """Sparse features (window, idx, value). Templates outside the vocabulary share the last idx."""
    unknown = vocab.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).scalar()
    idx = F.coalesce(F.col("idx"), unknown)
    cells = counts.join(vocab, "template_id", "left").groupBy("dataset", "window_id", idx.alias("idx")).agg(F.sum("n").alias("n"))
    if mode == "normalized_count":
        total = F.sum("n").over(Window.partitionBy("dataset", "window_id"))
        value = F.col("n") / total
    elif mode == "log1p_count":
        value = F.log1p("n")
    elif mode == "raw_count":
        value = F.col("n").cast("double")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return cells.select("dataset", "window_id", "idx", value.alias("value"))


def fit_frequency(train_counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed log probability per template; UNKNOWN always has a row."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    unknown = train_counts.sparkSession.range(1).select(F.lit(UNKNOWN_TEMPLATE).alias("template_id"), F.lit(0).cast("long").alias("n"))
    freq = train_counts.select("template_id", "n").unionByName(unknown).groupBy("template_id").agg(F.sum("n").alias("n"))
    freq = pin_small(freq)
    total, k = freq.agg(F.sum("n")).scalar(), freq.agg(F.count(F.lit(1))).scalar()
    return freq.select("template_id", F.log((F.col("n") + F.lit(alpha)) / (total + F.lit(alpha) * k)).alias("log_p"))


def frequency_scores(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """Mean surprise of the records of each window.

    Rounded to 9 places, so windows of equal content tie whatever order their terms were added in.
    """
    unknown = fitted.filter(F.col("template_id") == UNKNOWN_TEMPLATE).select("log_p").scalar()
    surprise = -F.coalesce(F.col("log_p"), unknown)
    joined = counts.join(fitted, "template_id", "left")
    return joined.groupBy("dataset", "window_id").agg(F.round(F.sum(F.col("n") * surprise) / F.sum("n"), 9).alias("score"))


def attach_scores(windows: DataFrame, scores: DataFrame, name: str = "score") -> DataFrame:
    """Windows with their score; a window without records scores 0."""
    s = scores.select("dataset", "window_id", F.col("score").alias("_s"))
    return windows.join(s, ["dataset", "window_id"], "left").withColumn(name, F.coalesce("_s", F.lit(0.0))).drop("_s")


def encode_sequences(sequences: DataFrame, vocab: DataFrame, max_len: int | None = None) -> DataFrame:
    """Token arrays over ``template_ids``: known templates from 2, others and nulls 1.

    ``max_len`` cuts a sequence to its first items; without it the whole window counts. A window
    without templates has no tokens. The vocabulary is joined, so its size decides nothing.
    """
    items = F.col("template_ids") if max_len is None else F.slice("template_ids", 1, max_len)
    rows = sequences.select("dataset", "window_id", F.posexplode_outer(items).alias("pos", "template_id"))
    token = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("idx", F.lit(UNKNOWN_TOKEN)).alias("token")))
    out = rows.join(vocab, "template_id", "left").groupBy("dataset", "window_id").agg(F.array_sort(F.collect_list(token)).alias("_t"))
    return out.select("dataset", "window_id", F.col("_t.token").alias("tokens"))


def pad_sequences(encoded: DataFrame, length: int | None = None) -> DataFrame:
    """Right-pad to the longest sequence (or ``length``) with a validity mask."""
    n = F.lit(length) if length else encoded.agg(F.max(F.size("tokens"))).scalar()
    size = F.size("tokens")
    return encoded.select(
        "dataset",
        "window_id",
        F.concat("tokens", F.array_repeat(F.lit(PAD_TOKEN), (n - size).cast("int"))).alias("input_ids"),
        size.alias("length"),
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: i < size).alias("attention_mask"),
    )


def _pairs(encoded: DataFrame) -> DataFrame:
    """(window, prev, next) rows. A one-token window gives one row with no predecessor."""
    t = F.col("tokens")
    steps = F.transform(
        F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(F.get(t, i).alias("prev"), x.alias("next"))
    )
    single = F.array(F.struct(F.lit(None).cast("int").alias("prev"), F.get(t, F.lit(0)).alias("next")))
    return encoded.select("dataset", "window_id", F.inline(F.when(F.size(t) == 1, single).otherwise(steps)))


def fit_next_template(encoded_train: DataFrame, vocab_size: int, alpha: float = 1.0) -> dict:
    """Order-1 model: smoothed token probabilities, step counts, and the floor of unseen tokens.

    ``vocab_size`` counts the known templates and UNKNOWN.
    """
    t = F.col("tokens")
    alone = F.transform(t, lambda x: F.struct(F.lit(None).cast("int").alias("prev"), x.alias("next")))
    after = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(F.get(t, i).alias("prev"), x.alias("next")))
    # tokens and steps are counted in one pass; a token's own count has no predecessor
    counts = pin_small(encoded_train.select(F.inline(F.concat(alone, after))).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("c")))
    uni, steps = counts.filter(F.col("prev").isNull()), counts.filter(F.col("prev").isNotNull())
    denominator = float(uni.agg(F.sum("c")).first()[0] or 0) + alpha * vocab_size
    return {
        "probs": uni.select("next", ((F.col("c") + F.lit(alpha)) / F.lit(denominator)).alias("p")),
        "steps": steps,
        "floor": alpha / denominator,
    }


def next_template_scores(encoded: DataFrame, model: dict, beta: float = 1.0) -> DataFrame:
    """Mean negative log-likelihood of each next token, backing off to the token probability."""
    context = model["steps"].groupBy("prev").agg(F.sum("c").alias("ctx"))
    rows = (
        _pairs(encoded)
        .join(model["probs"], "next", "left")
        .join(model["steps"], ["prev", "next"], "left")
        .join(context, "prev", "left")
    )
    p_next = F.coalesce("p", F.lit(model["floor"]))
    p = (F.coalesce("c", F.lit(0)) + F.lit(beta) * p_next) / (F.coalesce("ctx", F.lit(0)) + F.lit(beta))
    return rows.groupBy("dataset", "window_id").agg(F.round(F.avg(-F.log(p)), 9).alias("score"))


def _dense(features: DataFrame, d: int) -> DataFrame:
    """Sparse rows to one dense array per window; ``d`` is bounded by the caller."""
    cell = F.map_from_entries(F.collect_list(F.struct("idx", "value")))
    m = features.groupBy("dataset", "window_id").agg(cell.alias("_m"))
    return m.select("dataset", "window_id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("x"))


def fit_pca(train: DataFrame, d: int, variance_ratio: float | None = 0.95, n_components: int | None = None) -> dict:
    """Mean, components and their number. Only the d x d covariance leaves the executors.

    Beyond MAX_PCA_FEATURES no such matrix is formed: the components come from block power iteration over
    the sparse rows (``operators/pca.py``).
    """
    if d > MAX_PCA_FEATURES:
        return pca.fit_pca(train, d, variance_ratio, n_components)
    dense = _dense(train, d)
    model = PCA(k=d, inputCol="v", outputCol="z").fit(dense.select(array_to_vector("x").alias("v")))
    stats = dense.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    share = np.nan_to_num(model.explainedVariance.toArray())
    most = min(int(stats[0]["n"]), d)
    if n_components is not None:
        k = min(n_components, most)
    elif variance_ratio is not None:
        k = max(1, min(int(np.searchsorted(np.cumsum(share), variance_ratio) + 1), most))
    else:
        k = min(5, most)
    return {"mean": np.array([r["m"] for r in stats]), "components": model.pc.toArray()[:, :k], "k": k, "share": share[:k]}


def pca_scores(features: DataFrame, d: int, fitted: dict) -> DataFrame:
    """Squared reconstruction error |x-mu|^2 - |W'(x-mu)|^2 of each window."""
    if d > MAX_PCA_FEATURES:
        return pca.pca_scores(features, fitted)
    mean, w = fitted["mean"], fitted["components"]

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        c = np.stack(x.to_numpy()) - mean
        rest = c - (c @ w) @ w.T
        return pd.Series((rest * rest).sum(axis=1))

    return _dense(features, d).select("dataset", "window_id", error("x").alias("score"))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(d: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values(["h", "window_id"])["x"].to_numpy())
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes, stack = [], [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, rows, depth = stack.pop()
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[rows, f] <= cut
            nodes.append((tree, node, f, cut, next_id, next_id + 1, len(rows), depth))
            stack += [(next_id, rows[left], depth + 1), (next_id + 1, rows[~left], depth + 1)]
            next_id += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])

    return grow


def fit_isolation_forest(train: DataFrame, d: int, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Forest nodes. Every tree is grown in its own task on at most ``sample`` hashed rows.

    A row enters a tree if its hash for that tree is among the smallest; rows far above the
    expected cut are dropped before the shuffle, so about 3 x trees x sample rows move.
    """
    dense = _dense(train, d)
    n = dense.count()
    keep = min(1.0, 3.0 * sample / max(n, 1))
    low, span = -(2**63), 2.0**64
    bound = int(low + keep * (span - 2048))
    h = F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.struct(t.alias("tree"), F.xxhash64("window_id", t + F.lit(seed)).alias("h")))
    member = dense.select("window_id", "x", F.inline(F.filter(h, lambda s: (s["h"] <= bound) | F.lit(keep >= 1.0))))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "window_id"))
    chosen = member.withColumn("r", rank).filter(F.col("r") <= sample).drop("r")
    schema = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"
    return chosen.groupBy("tree").applyInPandas(_grow(d, seed), schema)


def isolation_scores(features: DataFrame, d: int, forest: DataFrame, sample: int = 256) -> DataFrame:
    """2^(-E[path] / c(sample)): higher is easier to isolate. The forest has a fixed size."""
    pdf = forest.toPandas().sort_values(["tree", "node"])
    arrays = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "size", "depth")) for _, g in pdf.groupby("tree")]
    used = int(max(a[4].max() for a in arrays))
    shared = features.sparkSession.sparkContext.broadcast(arrays)
    scale = float(_average_path(min(sample, used)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["x"].to_numpy())
            total = np.zeros(len(x))
            for feature, cut, left, right, size, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                while (feature[at] >= 0).any():
                    f = feature[at]
                    down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                    at = np.where(f >= 0, down, at)
                total += depth[at] + _average_path(size[at])
            yield pd.DataFrame({"dataset": b["dataset"], "window_id": b["window_id"], "score": 2.0 ** (-total / len(shared.value) / max(scale, 1e-9))})

    return _dense(features, d).mapInPandas(run, "dataset string, window_id string, score double")


def classify(scored: DataFrame, threshold: float | Column, strict: bool = True, score: str = "score") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    over = F.col(score) > t if strict else F.col(score) >= t
    return scored.withColumn("pred", over.cast("int"))
