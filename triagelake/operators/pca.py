"""Principal components of wide sparse rows by block power iteration; no feature x feature matrix anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize

#: features of one partial sum
CHUNK = 4_096
#: directions to begin with; they double until they hold the share of variance asked for
BLOCK = 32
#: added to the directions asked for, so that the last of them settle too
SPARE = 8
ROUNDS = 60
TOLERANCE = 1e-9


def sparse_rows(features: DataFrame) -> DataFrame:
    """(dataset, window_id, idx, value) cells as one row of two arrays per window."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return features.groupBy("dataset", "window_id").agg(cells.alias("c")).select("dataset", "window_id", F.col("c.idx").cast("array<bigint>").alias("idx"), F.col("c.value").alias("value"))


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, value) of all cells of a batch."""
    idx, value = b.column("idx"), b.column("value")
    size = np.diff(idx.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), idx.flatten().to_numpy(), value.flatten().to_numpy()


def _project(row: np.ndarray, idx: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]))
    np.add.at(out, row, value[:, None] * basis[idx])
    return out


def _pass(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(C Q, Q' C Q) for the sum of squares C of the centred rows: one job.

    A task adds up its rows in chunks of features, tasks are added chunk by chunk, and the driver
    gets the d x k sum. The mean enters as a rank-one term, so rows stay sparse.
    """
    spark, (d, k) = rows.sparkSession, basis.shape
    shared = spark.sparkContext.broadcast((basis, mean @ basis))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, centre = shared.value
        sums: dict[int, np.ndarray] = {}
        gram, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            row, idx, value = _cells(b)
            z = _project(row, idx, value, b.num_rows, q) - centre
            gram, total = gram + z.T @ z, total + z.sum(axis=0)
            for c in np.unique(idx // CHUNK):
                at = idx // CHUNK == c
                np.add.at(sums.setdefault(int(c), np.zeros((min(CHUNK, d - int(c) * CHUNK), k))), idx[at] - c * CHUNK, value[at, None] * z[row[at]])
        out = [*sums.items(), (-1, np.vstack((gram, total)))]
        for c, s in out:
            yield pa.RecordBatch.from_pydict({"chunk": [c], "data": [s.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                one = np.frombuffer(raw)
                sums[c] = sums[c] + one if c in sums else one
        for c, s in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": [c], "data": [s.tobytes()]})

    found = rows.select("idx", "value").mapInArrow(part, "chunk long, data binary").repartition("chunk").mapInArrow(add, "chunk long, data binary").collect()
    product, tail = np.zeros((d, k)), np.zeros((k + 1, k))
    for r in found:
        s = np.frombuffer(r["data"]).reshape(-1, k)
        if r["chunk"] < 0:
            tail = s
        else:
            product[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(s)] = s
    shared.unpersist()
    return product - np.outer(mean, tail[k]), tail[:k]


def fit_pca(train: DataFrame, d: int, variance_ratio: float | None = 0.95, n_components: int | None = None, seed: int = 42) -> dict:
    """Mean, components (d x k), k, their shares of the variance and their eigenvalues.

    Only d x k numbers reach the driver: the mean, the directions and their images. All directions are
    kept where no row is left (an empty table gives none).
    """
    rows = materialize(sparse_rows(train), "sparse-rows")
    n = rows.count()
    cells = train.groupBy("idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).collect()
    mean, square = np.zeros(d), np.zeros(d)
    for r in cells:
        mean[r["idx"]], square[r["idx"]] = r["s"] / max(n, 1), r["q"] / max(n, 1)
    whole = float(np.maximum(square - mean * mean, 0).sum())
    most = min(n, d)
    wanted = min(most, n_components or (BLOCK if variance_ratio is not None else 5))
    rng = np.random.default_rng(seed)
    basis = np.zeros((d, 0))
    while True:
        k = min(most, wanted + SPARE)
        fresh = rng.normal(size=(d, k - basis.shape[1]))
        basis, _ = np.linalg.qr(np.hstack((basis, fresh))) if k else (np.zeros((d, 0)), None)
        before, values, components = -1.0, np.zeros(0), basis
        for _ in range(ROUNDS if k else 0):
            product, gram = _pass(rows, basis, mean)
            values, turn = np.linalg.eigh(gram / n)
            values, components = values[::-1], basis @ turn[:, ::-1]
            held = float(values[:wanted].sum())
            if abs(held - before) <= TOLERANCE * max(whole, 1e-300):
                break
            before = held
            basis, _ = np.linalg.qr(product @ turn[:, ::-1])
        share = np.cumsum(values) / whole if whole > 0 else np.ones(len(values))
        if n_components is not None or variance_ratio is None or wanted >= most or (len(share) and share[wanted - 1] >= variance_ratio):
            break
        wanted, basis = min(most, 2 * wanted), components
    if n_components is None and variance_ratio is not None and len(share):
        wanted = max(1, min(int(np.searchsorted(share, variance_ratio) + 1), wanted))
    return {"mean": mean, "components": components[:, :wanted], "k": wanted, "share": np.maximum(values[:wanted], 0) / whole if whole > 0 else np.zeros(wanted), "eigenvalues": values[:wanted], "variance": whole}


def pca_scores(features: DataFrame, fitted: dict) -> DataFrame:
    """Squared reconstruction error |x-mu|^2 - |W'(x-mu)|^2 of each window, from its sparse cells alone."""
    spark = features.sparkSession
    mean, w = fitted["mean"], fitted["components"]
    shared = spark.sparkContext.broadcast((mean, w, mean @ w, float(mean @ mean)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, basis, centre, norm = shared.value
        for b in batches:
            row, idx, value = _cells(b)
            own = np.bincount(row, weights=value * value - 2 * value * mu[idx], minlength=b.num_rows) + norm
            z = _project(row, idx, value, b.num_rows, basis) - centre
            yield pa.RecordBatch.from_arrays([b.column("dataset"), b.column("window_id"), pa.array(np.maximum(own - (z * z).sum(axis=1), 0.0))], ["dataset", "window_id", "score"])

    return sparse_rows(features).mapInArrow(score, "dataset string, window_id string, score double")
