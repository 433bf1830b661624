"""Stage tables: windows, corpus, evidence, assessments, explanations, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.operators.splits import read_split

WINDOW_SCHEMA = (
    "dataset STRING, window_id STRING, session_id STRING, start_time DOUBLE, end_time DOUBLE, record_count BIGINT, template_ids ARRAY<INT>, raw_messages ARRAY<STRING>, "
    "is_anomaly BOOLEAN, first_line BIGINT, last_line BIGINT, has_unknown_template BOOLEAN, unmapped_label BOOLEAN, anomalous_record_count BIGINT, split STRING"
)


def write_windows(windows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write windows partitioned by split, as Parquet or JSON lines."""
    windows.write.partitionBy("split").format(fmt).mode("errorifexists").save(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None, evaluate: bool = False, fmt: str = "parquet", schema: str = WINDOW_SCHEMA) -> DataFrame:
    """Read windows; one split prunes to its folder. TEST needs ``evaluate``."""
    w = spark.read.schema(schema).format(fmt).load(path)
    return w if split is None else read_split(w, split, evaluate)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write one stage, nested columns included."""
    df.write.partitionBy(*partition_by).format(fmt).mode("errorifexists").save(path)


def write_with_items(df: DataFrame, path: str, items: str, key: str, fmt: str = "parquet") -> None:
    """Write a stage beside the exploded rows of one of its arrays (contributions, claims)."""
    write_stage(df, f"{path}/rows", fmt)
    write_stage(df.select(key, F.inline(items)), f"{path}/{items}", fmt)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Flat metric rows as CSV with a header; nested columns are refused."""
    nested = [f.name for f in metrics.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    if nested:
        raise ValueError(f"nested columns cannot go to CSV: {nested}")
    metrics.write.option("header", True).mode("errorifexists").csv(path)
