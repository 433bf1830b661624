"""Raw log files, label files and file integrity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions.text import strip


#: bytes that one hash covers
HASH_BLOCK = 64 << 20


def read_log_lines(spark: SparkSession, path: str, max_records: int | None = None, keep_blank: bool = False) -> DataFrame:
    """(file, line_number, record_index, raw_text) in one scan plus a count.

    ``line_number`` counts all lines of a file from 1, ``record_index`` those that aren't blank (NULL for
    a blank one). A text split is read in order, so a row's place in its split is its row id minus the
    smallest one there. The splits of a file are shifted by the counts of the earlier ones: one small
    row per split, so the raw lines are never shuffled. ``max_records`` cuts on raw line numbers.
    """
    scan = spark.read.text(path).select(
        strip(F.col("value")).alias("raw_text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )

    # both numbers are taken in the scan itself, before any join can move a row
    filled = scan.filter(F.col("raw_text") != "").withColumn("_rid", F.monotonically_increasing_id())

    def numbered(rows: DataFrame, by: DataFrame, key: str, out: str) -> DataFrame:
        sizes = by.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
        before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        # no hint: the optimizer broadcasts this side while it is small and shuffles otherwise
        return rows.join(offsets, ["file", "_start"]).withColumn(out, F.col("_before") + F.col(key) - F.col("_first") + 1).drop("_first", "_before")

    out = numbered(numbered(filled, filled, "_rid", "record_index"), scan, "_id", "line_number")
    if keep_blank:
        blank = numbered(scan.filter(F.col("raw_text") == ""), scan, "_id", "line_number")
        out = out.drop("_rid").unionByName(blank.withColumn("record_index", F.lit(None).cast("long")))
    out = out.select("file", "line_number", "record_index", "raw_text")
    return out if max_records is None else out.filter(F.col("line_number") <= max_records)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, is_anomaly) from a BlockId,Label file; the last line of a block wins."""
    lines = read_log_lines(spark, path)
    parts = F.split("raw_text", ",")
    rows = lines.filter(F.size(parts) >= 2).filter(~((F.col("line_number") == 1) & F.contains("raw_text", F.lit("BlockId"))))
    fields = rows.select(strip(F.get(parts, F.lit(0))).alias("session_id"), (F.lower(strip(F.get(parts, F.lit(1)))) == "anomaly").alias("v"), "file", "line_number")
    return fields.groupBy("session_id").agg(F.max_by("v", F.struct("file", "line_number")).alias("is_anomaly"))


def file_integrity(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) per file. One file is one row, as Spark's binary source reads it."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def block_integrity(spark: SparkSession, path: str, block_bytes: int = HASH_BLOCK, tasks: int | None = None) -> DataFrame:
    """(path, size_bytes, n_blocks, digest) per file of any size.

    Fixed byte ranges are hashed side by side; the digest of a file is the SHA-256 of its block digests in
    order, so it depends on ``block_bytes``. No file is read whole and none passes through one task.
    Spark lists no file of 0 bytes, so it has no row.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.greatest(F.floor((F.col("length") - 1) / block_bytes), F.lit(0))
    blocks = listed.select("path", F.col("length").alias("size_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for name, k in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                store, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", name))
                with store.open_input_file(at) as f:
                    f.seek(k * block_bytes)
                    h, left = hashlib.sha256(), block_bytes
                    while left and (piece := f.read(min(left, 1 << 20))):
                        h.update(piece)
                        left -= len(piece)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], [*b.schema.names, "digest"])

    done = blocks.repartition(n).mapInArrow(run, "path string, size_bytes long, block long, digest string")
    # 64 characters for each block_bytes of a file
    per = done.groupBy("path", "size_bytes").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("d"))
    return per.select("path", "size_bytes", "n_blocks", F.sha2(F.array_join("d.digest", ""), 256).alias("digest"))


def verify_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare with (path, sha256), ignoring case; a file on one side only does not match."""
    want = expected.select("path", F.lower("sha256").alias("_want"))
    out = actual.join(want, "path", "full_outer")
    return out.withColumn("matches", F.coalesce(F.lower("sha256") == F.col("_want"), F.lit(False))).drop("_want")
