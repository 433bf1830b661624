"""Severity of toxicity: cumulative-link ordinal regression on a sparse set of telling words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import map_batches, mix, only, prepared, shingle_hashes, texts, word_hashes, write_stage

#: at most so many labelled rows are fitted on, chosen by a hash of their doc_id
SAMPLE_ROWS = 20_000
#: at most so many words are features; each must be this far from chance in the sample, in this
#: share of the texts labelled 1, and leave at most this part of the usual share of texts labelled 0
MAX_FEATURES, MIN_Z, MIN_SHARE, MAX_CLEAN = 20_000, 5.0, 0.02, 1 / 3
#: texts of the sample that share the least shingle under one of so many hashes count once
MINIMA = 4
GRADES = 4
STEPS, RATE, RIDGE = 80, 0.3, 1e-5
REJECT_AT = 0.5

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def forms(word: str) -> tuple[str, ...]:
    """A word and its first four and five letters, which inflected and compound words share."""
    if len(word) <= 4:
        return (word,)
    return (word, f"{word[:4]}*") if len(word) == 5 else (word, f"{word[:4]}*", f"{word[:5]}*")


def features(text: str, known: dict[str, int]) -> dict[int, int]:
    """Feature numbers with their times."""
    return Counter(known[f] for w in tokens(text) for f in forms(w) if f in known)


@dataclass
class Severity:
    """``words``: numbers of words and word beginnings; one weight each for all thresholds, which ascend."""

    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        """P(grade = 0), ..., P(grade = top)."""
        s = sum(self.weights[i] * (1 + math.log(c)) for i, c in features(text, self.words).items())
        below = np.concatenate((_sigmoid(self.cuts - s), [1.0]))
        return np.diff(below, prepend=0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents; copies and near copies count once.

    The labels are bounded first, so that their side of the join is small whatever the tables hold. A
    group of near copies with one wrong label would make all its words telling; so of texts that
    agree in the least hash of their five-word shingles, under any of MINIMA hashes, one stays.
    """
    picked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("_id").isNotNull() & F.col("y").isNotNull())
    picked = picked.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(picked), "_id")
    whole, _ = write_stage(found.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y")), "labelled-texts")

    def least(b: pa.RecordBatch) -> dict:
        h, n = shingle_hashes(*word_hashes(texts(b)), 5)
        out = {"id": b.column("id")}
        for k in range(MINIMA):
            m = np.arange(b.num_rows, dtype=np.uint64)  # a text without words meets few others
            if len(h):
                m[n > 0] = np.minimum.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15 >> k)), (np.cumsum(n) - n)[n > 0])
            out[f"m{k}"] = pa.array(m.view(np.int64))
        return out

    ids = map_batches(whole.select(F.xxhash64("text").alias("id"), "text"), least, f"id long, {', '.join(f'm{k} long' for k in range(MINIMA))}")
    for k in range(MINIMA):  # a bounded number of rows
        ids = ids.withColumn(f"f{k}", F.min("id").over(Window.partitionBy(f"m{k}")))
    first = ids.filter(" AND ".join(f"id = f{k}" for k in range(MINIMA))).select("id")
    return whole.withColumn("id", F.xxhash64("text")).join(first, "id", "left_semi").select("text", "y")


def telling_words(sample: DataFrame, min_z: float = MIN_Z, min_share: float = MIN_SHARE, max_clean: float = MAX_CLEAN, most: int = MAX_FEATURES) -> list[tuple[str, float]]:
    """Words and word beginnings that tell texts with y > 0 from those with y = 0, and by how many deviations."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, y = [], []
            for t, g in zip(texts(b), b.column("y").to_pylist(), strict=True):
                own = {f for x in set(tokens(t)) for f in forms(x)}
                w.extend(own), y.extend([g > 0] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.bool_())], ["word", "bad"])

    n = sample.agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).first()
    if not n["bad"] or not n["good"]:
        return []
    share = n["bad"] / (n["bad"] + n["good"])
    seen = sample.mapInArrow(words, "word string, bad boolean").groupBy("word").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    often = F.col("bad") >= max(4.0, min_share * n["bad"])
    told = seen.withColumn("z", z).filter(often & (F.col("z") >= min_z) & (1 - F.col("bad") / F.col("n") <= max_clean * (1 - share))).orderBy(F.desc("z"), "word").limit(most)
    return [(r["word"], r["z"]) for r in told.select("word", "z").collect()]


def grade_binary(sample: DataFrame, words: list[tuple[str, float]]) -> DataFrame:
    """(text, grade) of 0/1 labels: 0 stays 0; a 1 is graded by its telling words.

    The labels know no degrees. A text labelled 1 is grade 1 with at most two telling words, grade 2
    with three to five, grade 3 with more. With graded labels this step is left out.
    """
    bad = {w for w, _ in words}

    def grade(b: pa.RecordBatch) -> dict:
        n = [sum(any(f in bad for f in forms(w)) for w in tokens(t)) for t in texts(b)]
        return {"text": b.column("text"), "grade": pa.array([0 if y <= 0 else 1 + (k > 2) + (k > 5) for y, k in zip(b.column("y").to_pylist(), n, strict=True)], pa.int32())}

    return map_batches(sample, grade, "text string, grade int")


def fit_ordinal(graded: DataFrame, words: list[str], grades: int = GRADES, steps: int = STEPS, ridge: float = RIDGE) -> Severity:
    """Maximum likelihood of P(grade <= k) = sigmoid(cut_k - w.x) with one w for all cuts.

    ``graded`` is (text, grade). Equal feature rows are summed first. Each step adds up the gradients
    that the partitions return, one row each, and moves by Adam; cut_k is cut_0 plus positive steps,
    so the cuts stay in order. Without words all weights are 0 and the cuts fit the shares.
    """
    index = {w: i for i, w in enumerate(words)}
    d = len(words)

    def rows_of(b: pa.RecordBatch) -> dict:
        n = [sorted(features(t, index).items()) for t in texts(b)]
        return {"grade": b.column("grade"), "at": pa.array([[i for i, _ in x] for x in n], pa.list_(pa.int32())), "tf": pa.array([[c for _, c in x] for x in n], pa.list_(pa.int32()))}

    rows = map_batches(graded.select("text", "grade"), rows_of, "grade int, at array<int>, tf array<int>")
    rows, _ = write_stage(rows.groupBy("grade", "at", "tf").agg(F.count(F.lit(1)).alias("n")).coalesce(4), "ordinal-rows")

    def gradient(params: np.ndarray):
        w, cuts = params[:d], _cuts(params[d:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, loss, total = np.zeros(d + grades - 1), 0.0, 0
            edges = np.concatenate(([-np.inf], cuts, [np.inf]))
            for b in batches:
                at, tf = b.column("at"), b.column("tf")
                size = np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(b.num_rows), size)
                i, x = at.flatten().to_numpy(), 1 + np.log(tf.flatten().to_numpy())
                s = np.bincount(row, weights=w[i] * x, minlength=b.num_rows)
                y, n = b.column("grade").to_numpy(), b.column("n").to_numpy()
                hi, lo = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
                p = np.maximum(hi - lo, 1e-12)
                loss -= float((n * np.log(p)).sum())
                total += int(n.sum())
                ds = n * (1 - hi - lo)  # of -log p
                g[:d] += -np.bincount(i, weights=-ds[row] * x, minlength=d) if d else 0
                up, down = hi * (1 - hi) / p * n, lo * (1 - lo) / p * n
                for k in range(grades - 1):
                    g[d + k] += down[y == k + 1].sum() - up[y == k].sum()
            yield pa.RecordBatch.from_pydict({"g": [g.tobytes()], "loss": [loss], "n": pa.array([total], pa.int64())})

        parts = rows.mapInArrow(run, "g binary, loss double, n long").collect()
        g, n = sum((np.frombuffer(p["g"]) for p in parts), np.zeros(d + grades - 1)), max(1, sum(p["n"] for p in parts))
        return g / n, sum(p["loss"] for p in parts) / n

    params = np.concatenate((np.zeros(d), [1.0], np.zeros(grades - 2)))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        g, _ = gradient(params)
        # the gradient by cuts becomes one by the first cut and the logs of the steps
        by_cut = g[d:].copy()
        g[d] = by_cut.sum()
        for k in range(1, grades - 1):
            g[d + k] = by_cut[k:].sum() * math.exp(params[d + k])
        g[:d] += ridge * params[:d]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Severity(index, params[:d], _cuts(params[d:]))


def _cuts(p: np.ndarray) -> np.ndarray:
    return p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))


def fit_severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Severity:
    """The model of 0/1 labels; with one class only, or no labels, it rejects nothing."""
    prepared(docs.sparkSession)
    sample, _ = write_stage(labelled_sample(docs, labels, label, rows), "labelled")
    told = telling_words(sample)
    if not told:
        return Severity({}, np.zeros(0), np.array([20.0, 21.0, 22.0]))
    return fit_ordinal(grade_binary(sample, told), [w for w, _ in told])


def score_severity(docs: DataFrame, model: Severity, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, expected_severity, grade (most likely) and rejected, one row per row.

    ``rejected`` if P(grade > 0) is at least ``reject_at``. A null or empty text has no features. The
    model has at most MAX_FEATURES words, so it is sent along whatever the tables hold.
    """
    prepared(docs.sparkSession)

    def score(b: pa.RecordBatch) -> dict:
        p = np.array([model.probabilities(t) for t in texts(b)])
        return {"doc_id": b.column("doc_id"), "expected_severity": p @ np.arange(p.shape[1]), "grade": pa.array(p.argmax(axis=1), pa.int32()), "rejected": 1 - p[:, 0] >= reject_at}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(only(docs, "doc_id", "text"), score, f"doc_id {kind}, expected_severity double, grade int, rejected boolean")


def keep_acceptable(docs: DataFrame, model: Severity, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns as they are."""
    prepared(docs.sparkSession)

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([1 - model.probabilities(t)[0] < reject_at for t in texts(b)], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
