"""Content hashes, citations and their verification as joins and ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import lower_key, sha, strip
from triagelake.operators.retrieval import template_text
from triagelake.operators.splits import LABEL_INDICATORS
from triagelake.functions.text import contains_any

VERSION = "1.0"


def canonical_source(messages: Column) -> Column:
    """Stripped records joined by newline. ``messages`` is the bounded array of one window."""
    return strip(F.array_join(F.transform(messages, strip), "\n"))


def source_hash(messages: Column) -> Column:
    return F.sha2(canonical_source(messages), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def citation_id(dataset: Column, split: Column, chunk: Column, window_id: Column, start: Column, end: Column) -> Column:
    none = F.lit("none")
    return sha(lower_key(dataset), lower_key(split), F.trim(chunk), F.trim(window_id), F.coalesce(start.cast("string"), none), F.coalesce(end.cast("string"), none))


def bundle_id(ids: Column, dataset: Column, version: str = VERSION) -> Column:
    return sha(lower_key(dataset), F.lit(version), F.array_join(F.transform(ids, lambda c: F.trim(c)), ","))


def citation_text(dataset: Column, split: Column, window_id: Column, start: Column, end: Column, records: Column) -> Column:
    """``[DATASET | split | window=.. | lines=a-b | records=n]``; parts without a value are left out."""
    lines = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("lines="), start, F.lit("-"), end)).when(start.isNotNull(), F.concat(F.lit("line="), start))
    count = F.when(records > 0, F.concat(F.lit("records="), records))
    return F.concat(F.lit("["), F.concat_ws(" | ", F.upper(dataset), F.lower(split), F.concat(F.lit("window="), window_id), lines, count), F.lit("]"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: SHA-256 of an order-free digest of all rows and their number."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    parts = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s"))
    return parts.select("rows", sha(F.col("rows").cast("string"), F.col("x").cast("string"), F.coalesce("s", F.lit(0)).cast("string")).alias("fingerprint"))


def resolve_sources(items: DataFrame, windows: DataFrame, on: str = "source_window_id") -> DataFrame:
    """Join each item with its TRAIN window; no window gives NULL columns. Hashes only the matches.

    Windows hold their content as bounded arrays, or, as sessions do, its ``source_hash`` and ``template_hash``.
    """
    hashed = {"source_hash", "template_hash"} <= set(windows.columns)
    content = ("source_hash", "template_hash") if hashed else ("raw_messages", "template_ids")
    src = windows.filter(F.col("split") == "train").select(
        F.col("dataset").alias("_d"), F.col("window_id").alias("_w"), F.col("first_line").alias("line_start"), F.col("last_line").alias("line_end"),
        F.col("record_count").alias("source_records"), *[F.col(c).alias(f"_{c}") for c in content],
    )
    out = items.join(src, (items["dataset"] == src["_d"]) & (items[on] == src["_w"]), "left")
    now = (F.col("_source_hash"), F.col("_template_hash")) if hashed else (source_hash(F.col("_raw_messages")), text_hash(template_text(F.col("_template_ids"))))
    return (
        out.withColumn("resolved", F.col("_w").isNotNull())
        .withColumn("now_source_hash", F.when(F.col("resolved"), now[0]))
        .withColumn("now_template_hash", F.when(F.col("resolved"), now[1]))
        .drop("_d", "_w", *[f"_{c}" for c in content])
    )


def create_citations(selected: DataFrame, windows: DataFrame, artifact: str | None = None) -> DataFrame:
    """Citations of the selected evidence; evidence without a TRAIN source gives none."""
    r = resolve_sources(selected, windows).filter("resolved").withColumn("split", F.lit("train"))
    cols = [F.col(c) for c in ("dataset", "split", "chunk_id", "source_window_id", "line_start", "line_end")]
    return r.select(
        "query_id",
        citation_id(*cols).alias("citation_id"),
        citation_text(F.col("dataset"), F.col("split"), F.col("source_window_id"), F.col("line_start"), F.col("line_end"), F.col("source_records")).alias("citation_text"),
        "chunk_id", "source_window_id", "dataset", "split", "selected_rank", "retrieval_score", "selection_score",
        F.struct("line_start", "line_end", F.col("source_records").alias("record_count")).alias("source_location"),
        F.col("now_source_hash").alias("source_content_hash"),
        F.col("now_template_hash").alias("template_content_hash"),
        F.lit(artifact).cast("string").alias("artifact_sha256"),
    )


def verify_citations(citations: DataFrame, windows: DataFrame, artifact: str | None = None) -> DataFrame:
    """Add ``status`` VALID / INVALID / UNRESOLVED; the first failing check names the reason."""
    loc = F.col("source_location")
    expected = citation_id(F.col("dataset"), F.col("split"), F.col("chunk_id"), F.col("source_window_id"), loc["line_start"], loc["line_end"])
    r = resolve_sources(citations, windows)
    reason = (
        F.when(lower_key(F.col("split")) != "train", "split_guard")
        .when(contains_any(F.col("citation_text"), LABEL_INDICATORS), "label_guard")
        .when(F.col("citation_id") != expected, "citation_id_mismatch")
        .when(~F.col("resolved"), "unresolved")
        .when(F.col("source_content_hash") != F.col("now_source_hash"), "source_hash_mismatch")
        .when(F.col("template_content_hash") != F.col("now_template_hash"), "template_hash_mismatch")
        .when(~F.col("artifact_sha256").eqNullSafe(F.lit(artifact).cast("string")), "artifact_mismatch")
        .otherwise("ok")
    )
    out = r.withColumn("reason", reason).drop("line_start", "line_end", "source_records", "resolved", "now_source_hash", "now_template_hash")
    return out.withColumn("status", F.when(F.col("reason") == "ok", "VALID").when(F.col("reason") == "unresolved", "UNRESOLVED").otherwise("INVALID"))


def create_bundles(queries: DataFrame, verified: DataFrame) -> DataFrame:
    """One bundle per query with its citations in rank order; a query without any is verified.

    A query has at most evidence_k citations, so the arrays are bounded.
    """
    item = F.struct("selected_rank", "citation_id", "citation_text", "chunk_id", "source_window_id", "retrieval_score", "selection_score", "source_location", "source_content_hash", "template_content_hash", "status")
    per = verified.groupBy("dataset", "query_id").agg(F.array_sort(F.collect_list(item)).alias("citations"), F.bool_and(F.col("status") == "VALID").alias("_ok"))
    empty = F.array().cast(per.schema["citations"].dataType)
    out = queries.select("dataset", "query_id").join(per, ["dataset", "query_id"], "left").withColumn("citations", F.coalesce("citations", empty))
    return out.select(
        bundle_id(F.col("citations.citation_id"), F.col("dataset")).alias("bundle_id"), "dataset", "query_id", F.lit("train").alias("split"),
        F.size("citations").alias("evidence_count"), "citations", F.coalesce("_ok", F.lit(True)).alias("all_verified"),
    )


def verify_bundles(bundles: DataFrame) -> DataFrame:
    def count(status: str) -> Column:
        return F.size(F.filter("citations", lambda c: c["status"] == status))

    return bundles.select(
        "bundle_id", "dataset", "query_id", F.size("citations").alias("total_citations"), count("VALID").alias("valid_count"),
        count("INVALID").alias("invalid_count"), count("UNRESOLVED").alias("unresolved_count"), "all_verified",
    )


def provenance_diagnostics(verified: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return verified.agg(
        n.alias("total_citations"), F.countDistinct("citation_id").alias("unique_citations"), F.countDistinct("chunk_id").alias("unique_chunks"),
        F.countDistinct("source_window_id").alias("unique_source_windows"), (n - F.countDistinct("citation_id")).alias("duplicate_citations"),
        F.try_divide(F.count_if(F.col("status") == "VALID"), n).alias("verification_success_rate"),
        F.try_divide(F.count_if(F.col("status") != "UNRESOLVED"), n).alias("resolution_success_rate"),
    )
