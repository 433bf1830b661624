"""Lines repeated across documents, found with a once-seen and a twice-seen Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import BLANK, give_back, prepared, texts, write_stage

MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3
HASHES = 5
#: bits of each filter: 2**MIN_BITS to 2**MAX_BITS, by the optimizer's size of the input
MIN_BITS, MAX_BITS = 20, 26
SLICE_BYTES = 1 << 13


def line_keys(text: str, min_code_points: int = MIN_CODE_POINTS) -> Iterator[tuple[str, bytes | None]]:
    """(line, 128-bit digest of its key), the digest None where the key is too short to count."""
    for line in text.split("\n"):
        key = line.strip(BLANK)
        # bytes.lower() changes A-Z alone
        yield line, xxhash.xxh3_128_digest(key.encode("utf-8", "replace").lower()) if len(key) >= min_code_points else None


def _distinct(text: str, least: int) -> set[bytes]:
    return {d for _, d in line_keys(text, least) if d is not None}


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """HASHES bit positions of each digest, by double hashing."""
    h = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    step = h[:, 1:] | np.uint64(1)
    return (h[:, :1] + step * np.arange(HASHES, dtype=np.uint64)) & np.uint64((1 << bits) - 1)


def _test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of positions have all their bits."""
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def _filter_bits(df: DataFrame) -> int:
    """About 10 bits per line of 100 bytes. Only the number of false suspects depends on it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MAX_BITS, max(MIN_BITS, (size // 8).bit_length()))


def twice_seen(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, bits: int | None = None) -> np.ndarray:
    """Bitmap that holds every line key found in two or more documents, and a few others.

    Each task keeps two filters of a fixed size over all its partitions; their slices are then
    merged slice by slice on the executors. A bit set in two once-seen filters is twice-seen, so no
    repeat is missed. The driver gets one merged filter of at most 2**MAX_BITS bits.
    """
    bits = bits or _filter_bits(docs)
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(2))
        for b in batches:
            digests = [d for t in texts(b) for d in _distinct(t, min_code_points)]
            if not digests:
                continue
            at = _positions(digests, bits)
            _, first, n = np.unique(at[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ at[:, 1], return_index=True, return_counts=True)
            _set(twice, at[first[n > 1]])
            at = at[first]
            _set(twice, at[_test(once, at)])
            _set(once, at)
        step = min(SLICE_BYTES, len(once))
        for k in range(0, len(once), step * 64):
            cuts = [j for j in range(k, min(k + step * 64, len(once)), step) if once[j : j + step].any()]
            if cuts:
                yield pa.RecordBatch.from_pydict({"slice": [j // step for j in cuts], "once": [once[j : j + step].tobytes() for j in cuts], "twice": [twice[j : j + step].tobytes() for j in cuts]})
        del once, twice
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, t = (np.frombuffer(x, dtype=np.uint8) for x in (o, t))
                if k in seen:
                    once, twice = seen[k]
                    twice |= t | (once & o)
                    once |= o
                else:
                    seen[k] = [o.copy(), t.copy()]
        keys = [k for k, v in seen.items() if v[1].any()]
        if keys:
            yield pa.RecordBatch.from_pydict({"slice": keys, "twice": [seen[k][1].tobytes() for k in keys]})
        seen.clear()
        give_back()

    tasks = max(1, spark.sparkContext.defaultParallelism)
    parts = docs.select("text").coalesce(tasks).mapInArrow(build, "slice long, once binary, twice binary")
    merged = parts.repartition("slice").mapInArrow(merge, "slice long, twice binary")
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = min(SLICE_BYTES, len(bitmap))
    for r in merged.toLocalIterator():
        bitmap[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["twice"], dtype=np.uint8)
    return bitmap


def repeated_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS, bits: int | None = None) -> DataFrame:
    """(doc_id, drop): per document the digests of the keys whose lines it loses.

    Only keys that the twice-seen filter suspects are shuffled, as 16-byte digests; there they are
    counted exactly, and the largest doc_id of each key keeps its lines.
    """
    spark = docs.sparkSession
    bitmap = twice_seen(docs, min_code_points, bits)
    size = len(bitmap).bit_length() + 2
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, dtype=np.uint8)
        for b in batches:
            ids, digests = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                own = _distinct(t, min_code_points)
                digests.extend(own)
                ids.extend([i] * len(own))
            if digests:
                hit = np.flatnonzero(_test(twice, _positions(digests, size)))
                yield pa.RecordBatch.from_arrays([pa.array([digests[j] for j in hit], pa.binary()), pa.array([ids[j] for j in hit], b.schema.field("doc_id").type)], ["key", "doc_id"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    found, _ = write_stage(docs.select("doc_id", "text").mapInArrow(suspects, f"key binary, doc_id {kind}").distinct(), "line-suspects")
    # written first, so that both sides of the join are shuffled for it and a hot key is split
    counted, _ = write_stage(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_documents).select("key", "keeper"), "repeated-lines")
    loses = found.join(counted, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return loses.groupBy("doc_id").agg(F.collect_list("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS, bits: int | None = None) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, plus n_lines and n_dropped.

    A key of at least ``min_code_points`` code points found in at least ``min_documents`` documents
    loses all its lines except those of the largest doc_id that holds it. A null text is one empty
    line. Rows with the same doc_id count as one document; a null doc_id is one document, smaller
    than all others. ``doc_id`` may have any type that can be ordered. Columns of the input named n_lines or
    n_dropped, in whatever case, are replaced; others stay.
    """
    prepared(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    # the input travels as one struct, so no name of its columns meets one of the operator's
    drops = repeated_lines(docs, min_code_points, min_documents, bits).select(F.col("doc_id").alias("id"), "drop")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    joined = held.join(drops, F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    rows = joined.select("drop", "row")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            row = held.column("row")
            b = pa.RecordBatch.from_arrays(row.flatten(), kept)
            out, total, lost = [], [], []
            for t, d in zip(texts(b), held.column("drop").to_pylist(), strict=True):
                if d:
                    gone = set(d)
                    lines = list(line_keys(t, min_code_points))
                    stay = [line for line, key in lines if key not in gone]
                    out.append("\n".join(stay)), total.append(len(lines)), lost.append(len(lines) - len(stay))
                else:
                    out.append(t), total.append(t.count("\n") + 1), lost.append(0)
            cols = [pa.array(out, pa.string()) if c == "text" else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*kept, "n_lines", "n_dropped"])
        give_back()

    fields = docs.select(*[f"`{c}`" for c in kept]).schema
    return rows.mapInArrow(rewrite, fields.add("n_lines", "long").add("n_dropped", "long"))
