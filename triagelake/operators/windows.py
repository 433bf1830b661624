"""Grouping log records into windows.

A window is a row of plain aggregates; its content is kept long, as one row per
(window, template) with a count, or one row per (window, position). No operator builds an array
over a group without a bound, so one huge session costs no more than many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import order_positions

UNKNOWN_TEMPLATE = -1


def fixed_window_key(index: Column, size: int, prefix: str) -> Column:
    """Window id of a record from its 1-based position among the non-blank lines."""
    return F.format_string(f"{prefix}_window_%07d", F.floor((index - 1) / size))


def _in_file(records: DataFrame, key: Column) -> Column:
    """A window id that names its file, where there may be several."""
    return F.concat_ws("@", key, F.col("file")) if "file" in records.columns else key


def _window_aggregates(has_time: Column) -> list[Column]:
    """``_order`` is the order inside the window; times ignore records without one."""
    pos = F.when(has_time, F.col("_order"))
    return [
        F.min_by("timestamp", pos).alias("start_time"),
        F.max_by("timestamp", pos).alias("end_time"),
        F.count(F.lit(1)).alias("record_count"),
        F.min_by("line_number", F.col("_order")).alias("first_line"),
        F.max_by("line_number", F.col("_order")).alias("last_line"),
        F.bool_or(F.col("template_id") == UNKNOWN_TEMPLATE).alias("has_unknown_template"),
        F.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("anomalous_record_count"),
    ]


def fixed_windows(records: DataFrame, size: int = 100, min_size: int = 1, index: str = "line_number", prefix: str = "fixed", messages: bool = False) -> DataFrame:
    """Windows of ``size`` consecutive records; a last partial one stays if it has ``min_size``.

    ``index`` counts the non-blank records of a file from 1 (``record_index`` of the line reader). With a
    ``file`` column no window spans two files, and its id names the file.

    ``template_ids`` and, on request, ``raw_messages`` are arrays of at most ``size`` items.

    Consecutive lines sit in the same input split, so the map-side combine does nearly all work.
    """
    keyed = records.withColumn("window_id", _in_file(records, fixed_window_key(F.col(index), size, prefix))).withColumn("_order", F.col(index))
    kept = ["template_id", "raw_message"] if messages else ["template_id"]
    items = F.array_sort(F.collect_list(F.struct("_order", *kept))).alias("_items")  # at most ``size`` items
    out = keyed.groupBy("dataset", "window_id").agg(*_window_aggregates(F.col("timestamp").isNotNull()), items)
    out = out.select("*", *[F.col(f"_items.{c}").alias(f"{c}s") for c in kept]).drop("_items")
    return (
        out.filter(F.col("record_count") >= min_size)
        .withColumn("session_id", F.lit(None).cast("string"))
        .withColumn("is_anomaly", F.col("anomalous_record_count") > 0)
    )


def session_order() -> Column:
    """Order inside a session: time (missing first), then line number."""
    return F.struct(F.coalesce(F.col("timestamp"), F.lit(-1.0)).alias("t"), F.col("line_number").alias("l"))


def session_windows(records: DataFrame, labels: DataFrame | None = None, prefix: str = "session") -> DataFrame:
    """One window per session key; records without a key are left out.

    ``labels`` has (session_id, is_anomaly); a session it does not name is normal and flagged.
    """
    keyed = records.filter(F.col("session_id").isNotNull() & (F.col("session_id") != "")).withColumn("_order", session_order())
    out = keyed.groupBy("dataset", "session_id").agg(*_window_aggregates(F.col("timestamp").isNotNull()))
    out = out.withColumn("window_id", F.concat(F.lit(f"{prefix}_"), "session_id"))
    if labels is None:
        return out.withColumn("is_anomaly", F.lit(False)).withColumn("unmapped_label", F.lit(True))
    lab = labels.select("session_id", F.col("is_anomaly").alias("_label"))
    return (
        out.join(lab, "session_id", "left")
        .withColumn("is_anomaly", F.coalesce("_label", F.lit(False)))
        .withColumn("unmapped_label", F.col("_label").isNull())
        .drop("_label")
    )


def window_order_key(windows: DataFrame) -> DataFrame:
    """Add the chronological sort key: (start time or +inf, first line, id)."""
    start = F.coalesce(F.col("start_time"), F.lit(float("inf")))
    return windows.withColumn("order_key", F.struct(start.alias("t"), F.col("first_line").alias("l"), F.col("window_id").alias("w")))


def any_anomaly_label(records: DataFrame, key: str = "session_id") -> DataFrame:
    """Labels for sessions from record flags: anomalous if any record is."""
    return records.groupBy(key).agg(F.bool_or(F.coalesce("is_anomaly", F.lit(False))).alias("is_anomaly"))


def sequence_counts(windows: DataFrame) -> DataFrame:
    """(window, template, n) from bounded ``template_ids`` arrays."""
    rows = windows.select("dataset", "window_id", F.explode("template_ids").alias("template_id"))
    return rows.groupBy("dataset", "window_id", "template_id").agg(F.count(F.lit(1)).alias("n"))


def template_counts(records: DataFrame) -> DataFrame:
    """(window, template, n): the content of a window without its order."""
    return records.groupBy("dataset", "window_id", "template_id").agg(F.count(F.lit(1)).alias("n"))


def with_fixed_window(records: DataFrame, size: int, prefix: str, index: str = "line_number") -> DataFrame:
    """Records with their fixed ``window_id`` and 0-based ``pos`` inside it; needs no shuffle."""
    return records.withColumn("window_id", _in_file(records, fixed_window_key(F.col(index), size, prefix))).withColumn("pos", (F.col(index) - 1) % size)


def with_session_window(records: DataFrame, prefix: str) -> DataFrame:
    """Records with their session ``window_id`` and 0-based ``pos``, safe for huge sessions."""
    keyed = (
        records.filter(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
        .withColumn("window_id", F.concat(F.lit(f"{prefix}_"), "session_id"))
        .withColumn("_t", F.coalesce("timestamp", F.lit(-1.0)))
    )
    return order_positions(keyed, "_t", "line_number", by=["dataset", "window_id"]).drop("_t")


def session_prefix(records: DataFrame, prefix: str, max_len: int) -> DataFrame:
    """First ``max_len`` records of every session with their ``pos``.

    The rank filter runs in the map tasks first, so a session of any size sends at most
    ``max_len`` rows per map task.
    """
    keyed = records.filter(F.col("session_id").isNotNull() & (F.col("session_id") != "")).withColumn(
        "window_id", F.concat(F.lit(f"{prefix}_"), "session_id")
    )
    w = Window.partitionBy("dataset", "window_id").orderBy(F.coalesce("timestamp", F.lit(-1.0)), "line_number")
    return keyed.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < max_len)


def bounded_sequences(positioned: DataFrame, columns: list[str], max_len: int) -> DataFrame:
    """Ordered arrays per window, cut into segments of ``max_len`` positions.

    Every array is bounded; a longer window has several segments, so nothing is dropped.
    """
    seg = F.floor(F.col("pos") / max_len).alias("segment")
    item = F.struct("pos", *columns)
    out = positioned.groupBy("dataset", "window_id", seg).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return out.select("dataset", "window_id", "segment", *[F.col(f"_items.{c}").alias(f"{c}s") for c in columns])
