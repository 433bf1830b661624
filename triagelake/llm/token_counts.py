"""Document lengths from flat token files: a separator scan over blocks, stitched by a prefix scan."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import scratch_dir
from triagelake.llm.common import prepared, texts, write_stage

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the split pattern of that vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: fixed value: what \s means in that pattern
_BLANK_RUN = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}"
#: runs of blanks from this length on are encoded on their own: the pattern's look-ahead can't pass long ones
LONG_BLANKS = 10_000
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; ``file:`` may come with one slash or three."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def encode_text(enc: tiktoken.Encoding, text: str, long_blanks: int = LONG_BLANKS) -> list[int]:
    """Tokens of a text of any kind, the same as the encoder's own.

    A run of blanks always begins a piece of the pattern. All of it is one piece at the end of a text; elsewhere
    its last blank belongs to what follows. So a long run is cut out, encoded as the piece it is, and the rest as usual.
    """
    out, at = [], 0
    for m in re.finditer(_BLANK_RUN % long_blanks, text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : stop]) if stop > m.start() else []
        at = stop
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def write_token_files(docs: DataFrame, folder: str, ranks_path: str = RANKS_PATH, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Encode every text and write flat token files; (file, ordinal, doc_id) of what they hold.

    A file is one task's tokens with ``separator`` after each document and nothing else: no header,
    no index. A task that fails leaves a file that the returned, written table doesn't name. The
    folder must be one that all executors and the driver share.
    """
    spark = prepared(docs.sparkSession)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        enc = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        store, root = _store(folder)
        name, at = f"part-{uuid.uuid4().hex}.bin", 0
        end = np.array([separator], dtype=dtype).tobytes()
        with store.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for t in texts(b):
                    out.write(np.asarray(encode_text(enc, t), dtype=dtype).tobytes())
                    out.write(end)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), b.column("doc_id")], ["file", "ordinal", "doc_id"])
                at += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    held, _ = write_stage(docs.select("doc_id", "text").mapInArrow(encode, f"file string, ordinal long, doc_id {kind}"), "token-manifest")
    return held


def scan_separators(spark: SparkSession, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n_tokens, ends): positions of the separators in each block of each token file.

    Blocks are byte ranges of the files, dealt out evenly, so one huge file spreads over all tasks.
    """
    width = np.dtype(dtype).itemsize
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    size = F.floor(F.col("length") / width)
    blocks = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((size - 1) / block_tokens), F.lit(0)))).alias("block"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for name, k in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    f.seek(k * block_tokens * width)
                    raw = f.read(block_tokens * width)
                tokens = np.frombuffer(raw[: len(raw) // width * width], dtype=dtype)
                ends = np.flatnonzero(tokens == separator) + k * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n_tokens", "ends"])

    return blocks.repartition(tasks).mapInArrow(scan, "file string, block long, n_tokens long, ends array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document of every file.

    ``blocks`` is the scan, written as a stage. The prefix scan runs over one small row per block:
    how many separators came before it and where the last one was. So a document that spans blocks
    gets its start from an earlier block. Two separators in a row are a document of 0 tokens; tokens
    after the last separator of a file are a document that isn't terminated; an empty file has none.
    """
    stats = blocks.select("file", "block", "n_tokens", F.size("ends").alias("n"), F.element_at("ends", -1).alias("last")).withColumn("last", F.when(F.col("n") > 0, F.col("last")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"))
    ends = blocks.join(offsets, ["file", "block"]).select("file", "first", "prior", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("prior")).otherwise(F.expr("ends[k - 1]")) + 1
    closed = ends.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    whole = stats.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = whole.filter(F.col("total") > F.col("start")).select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(rest)


def document_tokens(docs: DataFrame, ranks_path: str = RANKS_PATH, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted in flat token files made from it.

    Equal rows give equal rows; a null or empty text has 0 tokens; a null doc_id is passed through.
    """
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    held = write_token_files(docs, folder, ranks_path, separator, dtype)
    blocks, _ = write_stage(scan_separators(spark, folder, separator, dtype, block_tokens), "token-blocks")
    return held.join(document_lengths(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
