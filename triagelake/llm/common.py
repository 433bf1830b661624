"""Shared helpers of the corpus operators: Arrow batches, word hashes, stage folders."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import scratch_dir

#: fixed values: the white space of the contracts, space and tab to carriage return
BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: odd factor of the rolling hash and its inverse modulo 2**64
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: text bytes hashed at once; a longer text is a piece of its own
PIECE_BYTES = 1 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage folder made by this package once nothing reads it again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; a null is an empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and hold what one task once used."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch; a dict is taken as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        give_back()

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for f in (_FACTOR, _INVERSE):
        a = np.full(n, f, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift and multiply)."""
    x = np.array(x, np.uint64)
    mix_into(x, np.empty_like(x))
    return x


def mix_into(x: np.ndarray, spare: np.ndarray) -> None:
    """``mix`` in place; ``spare`` is an array of the same shape to work in."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, None):
        np.bitwise_xor(x, np.right_shift(x, np.uint64(33), out=spare), out=x)
        if factor is not None:
            np.multiply(x, np.uint64(factor), out=x)


_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[ord(c) for c in BLANK]] = True


def _hash_piece(piece: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in piece]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = _IS_BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    h = mix(h ^ ((last - first).astype(np.uint64) << np.uint64(48)))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return h, np.diff(np.searchsorted(first, ends), prepend=0)


def word_hashes(batch: Sequence[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text.

    A word is a run of non-blank characters. ``lower`` lower-cases A-Z. The hash is a polynomial
    over the UTF-8 bytes, taken from one running sum, so the cost is a few passes over the bytes.
    """
    hs, ns, piece, size = [], [], [], 0
    for t in batch:
        piece.append(t)
        size += len(t)
        if size >= PIECE_BYTES:
            h, n = _hash_piece(piece, lower)
            hs.append(h), ns.append(n)
            piece, size = [], 0
    if piece:
        h, n = _hash_piece(piece, lower)
        hs.append(h), ns.append(n)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ns)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and their number per text.

    A text of 1 to k - 1 words has one shingle, of all its words; an empty one has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    n = int(per.sum())
    text = np.repeat(np.arange(len(counts)), per)
    pos = np.arange(n) - np.repeat(np.cumsum(per) - per, per) + starts[text]
    stop = ends[text]
    h = np.full(n, 0x51ED270B, dtype=np.uint64)
    pad = np.concatenate((words, np.zeros(1, np.uint64)))
    for j in range(k):
        at = pos + j
        word = np.where(at < stop, pad[np.minimum(at, len(words))], np.uint64(0))
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + word)
    return h, per


def write_stage(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write a stage as Parquet into the shared folder; the table read back, and its path."""
    import uuid

    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # nothing reads the shuffles of a written stage again
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is null. Other columns never meet the operator's own."""
    have = {c: None for c in df.columns}
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])
