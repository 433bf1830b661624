"""Stages shared by the composed queries, and the matching SQL for the cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.scale import materialize
from triagelake.operators import scorers, splits, windows
from triagelake.sources import tables

WINDOW_SIZE = 5
ALPHA = 0.05


def rounded(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles to 6 places so that two engines agree; ``keep`` names exact columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            c = (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def event_windows(spark: SparkSession, sf_dir: str, messages: bool = False) -> DataFrame:
    """Fixed windows over the events with their split, written once."""
    r = tables.event_records(spark, sf_dir)
    w = windows.fixed_windows(r, WINDOW_SIZE, prefix="events", messages=messages)
    w = materialize(w, "windows")
    return splits.chronological_split(w)


def b0_scored(w: DataFrame) -> DataFrame:
    """Windows with the frequency score fitted on TRAIN, and ``y``."""
    counts = windows.sequence_counts(w)
    fit = scorers.fit_frequency(windows.sequence_counts(w.filter(F.col("split") == "train")))
    scored = scorers.attach_scores(w, scorers.frequency_scores(counts, fit))
    return scored.withColumn("y", F.col("is_anomaly").cast("int"))


def b2_model(w: DataFrame) -> tuple[dict, DataFrame]:
    """Next-template model of the normal TRAIN windows, and the token vocabulary."""
    train = w.filter(F.col("split") == "train")
    vocab = scorers.vocabulary(windows.sequence_counts(train), first_index=2)
    fit = splits.normal_subsplit(train).filter(F.col("subset") == "fit")
    k = vocab.count() + 1
    return scorers.fit_next_template(scorers.encode_sequences(fit, vocab), k), vocab


def b2_scored(w: DataFrame, name: str = "b2_score") -> DataFrame:
    model, vocab = b2_model(w)
    return scorers.attach_scores(w, scorers.next_template_scores(scorers.encode_sequences(w, vocab), model), name)


def scored_stage(spark: SparkSession, sf_dir: str, b2: bool = False) -> DataFrame:
    """The scored windows as a written table: the start of every later stage."""
    w = b0_scored(event_windows(spark, sf_dir))
    return materialize(b2_scored(w) if b2 else w, "scored")


# ---- the same stages in SQL -------------------------------------------------------------------

RECORDS = """
rec AS (
  SELECT 'events' AS dataset, event_id + 1 AS line_number, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0::DOUBLE AS ts_s,
         'u' || user_id AS session_id, user_id, value,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE -1 END AS template_id,
         event_type AS template, event_type || ' ' || props AS raw_message, (event_type = 'error' AND value > 100) AS is_anomaly
  FROM events)"""

WINDOWS = RECORDS + """,
wrec AS (SELECT *, 'events_window_' || lpad(CAST((line_number - 1) // 5 AS VARCHAR), 7, '0') AS window_id, (line_number - 1) % 5 AS pos FROM rec),
win0 AS (
  SELECT dataset, window_id, arg_min(ts_s, line_number) AS start_time, arg_max(ts_s, line_number) AS end_time,
         count(*) AS record_count, min(line_number) AS first_line, max(line_number) AS last_line,
         count(*) FILTER (WHERE is_anomaly) AS anomalous_record_count, bool_or(is_anomaly) AS is_anomaly,
         list(template_id ORDER BY line_number) AS template_ids
  FROM wrec GROUP BY ALL),
runs AS (SELECT start_time AS t, CAST(sum(count(*)) OVER (ORDER BY start_time) AS BIGINT) AS upto FROM win0 GROUP BY start_time),
cuts AS (
  SELECT min(t) FILTER (WHERE upto > floor((SELECT count(*) FROM win0) * 0.6::DOUBLE)) AS t1,
         min(t) FILTER (WHERE upto > floor((SELECT count(*) FROM win0) * 0.8::DOUBLE)) AS t2 FROM runs),
win AS (
  SELECT win0.*, CASE WHEN start_time < t1 THEN 'train' WHEN start_time < t2 THEN 'calibration' ELSE 'test' END AS split
  FROM win0, cuts)"""

B0 = WINDOWS + """,
trec AS (SELECT wrec.* FROM wrec JOIN win USING (window_id) WHERE win.split = 'train'),
freq AS (SELECT template_id, count(*) AS n FROM trec GROUP BY 1),
freq_all AS (SELECT * FROM freq UNION ALL SELECT -1, 0 WHERE NOT EXISTS (SELECT 1 FROM freq WHERE template_id = -1)),
b0fit AS (SELECT template_id, ln((n + 1.0::DOUBLE) / ((SELECT sum(n) FROM freq_all) + 1.0::DOUBLE * (SELECT count(*) FROM freq_all))) AS log_p FROM freq_all),
b0 AS (
  SELECT window_id, avg(-coalesce(log_p, (SELECT log_p FROM b0fit WHERE template_id = -1))) AS score
  FROM wrec LEFT JOIN b0fit USING (template_id) GROUP BY 1),
scored0 AS (SELECT win.*, round(b0.score, 9) AS score, CAST(is_anomaly AS INTEGER) AS y FROM win JOIN b0 USING (window_id))"""


def sql(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()
