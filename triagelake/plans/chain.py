"""Raw lines to decisions in one chain, fitted on TRAIN only, over fixed and over session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, spread
from triagelake.operators import calibration as cal
from triagelake.operators import parse, scorers, splits, templates, windows
from triagelake.plans.base import ALPHA, WINDOW_SIZE, rounded, sql
from triagelake.sources import tables

#: the last tenth of the events prints another verb, so TEST has lines that no TRAIN template fits
LATE_SHARE = 0.9


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Printed lines and, beside them, the labels of their records."""
    e = tables.table(spark, sf, "events")
    n = e.agg(F.count(F.lit(1))).scalar()
    late = F.col("line_number") > n * F.lit(LATE_SHARE)
    lines = tables.as_lines(spread(e, "event_id", "ts", "user_id")).withColumn("raw_text", F.when(late, F.replace(F.col("raw_text"), F.lit("Handled view"), F.lit("Refused view"))).otherwise(F.col("raw_text")))
    labels = e.select((F.col("event_id") + 1).alias("line_number"), ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("is_anomaly"))
    return lines, labels


def _decided(parsed: DataFrame, bare: DataFrame, key: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Split, mine TRAIN, freeze, match, score and gate.

    ``bare`` are the windows without templates, ``key`` names the window of each line. Window content
    stays long, as counts of templates, so a window may hold any share of the lines.
    """
    split = materialize(splits.chronological_split(bare).drop("has_unknown_template"), "split-windows")
    placed = materialize(parsed.join(key, "line_number").join(split.select("window_id", "split"), "window_id"), "placed-lines")
    frozen = templates.mine_templates(placed.filter(F.col("split") == "train"), shape="shape")
    matched = templates.match_templates(placed, frozen, shape="shape")
    counts = materialize(windows.template_counts(matched), "template-counts")
    fit = scorers.fit_frequency(counts.join(split.filter(F.col("split") == "train").select("window_id"), "window_id", "left_semi"))
    unknown = counts.groupBy("dataset", "window_id").agg(F.bool_or(F.col("template_id") == windows.UNKNOWN_TEMPLATE).alias("has_unknown_template"))
    scored = scorers.attach_scores(split.join(unknown, ["dataset", "window_id"]), scorers.frequency_scores(counts, fit))
    scored = materialize(scored, "scored")
    tau = cal.threshold_map(scored.filter(F.col("split") == "calibration"), [alpha])[alpha]
    out = cal.gate(scored, tau)
    return rounded(out.select("window_id", "split", "record_count", "anomalous_record_count", "has_unknown_template", "is_anomaly", "score", "decision"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    lines, labels = _lines(spark, sf)
    parsed = templates.with_shape(parse.parse_lines(lines, "hdfs").drop("is_anomaly", "raw_message"))
    return materialize(parsed.join(labels, "line_number"), "parsed")


def raw_fixed_slice(spark, sf):
    p = _parsed(spark, sf)
    bare = windows.fixed_windows(p.withColumn("template_id", F.lit(0)), WINDOW_SIZE, prefix="raw").drop("template_ids")
    return _decided(p, bare, windows.with_fixed_window(p, WINDOW_SIZE, "raw").select("line_number", "window_id"))


def raw_session_slice(spark, sf):
    p = _parsed(spark, sf)
    labels = windows.any_anomaly_label(p)
    bare = windows.session_windows(p.withColumn("template_id", F.lit(0)), labels, prefix="raw")
    key = p.filter(F.col("session_id").isNotNull() & (F.col("session_id") != "")).select("line_number", F.concat(F.lit("raw_"), "session_id").alias("window_id"))
    return _decided(p, bare, key)


QUERIES = {f.__name__: f for f in (raw_fixed_slice, raw_session_slice)}

_LINES = r"""
ev AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
lines AS (
  SELECT event_id + 1 AS line_number, user_id, CAST(floor(epoch_us(ts) / 1000000.0::DOUBLE) AS DOUBLE) AS t, user_id % 10 <> 1 AS ok, event_type = 'error' AND value > 100 AS is_anomaly,
    CASE WHEN event_id + 1 > (SELECT count(*) FROM events) * 0.9::DOUBLE AND event_type = 'view' THEN 'Refused ' ELSE 'Handled ' END || event_type AS verb FROM ev),
"""


def _chain(window: str) -> str:
    """``window`` is the SQL expression of a line's window id."""
    return _LINES + f"""
rec AS (SELECT line_number, {window} AS window_id, CASE WHEN ok THEN t END AS t, CASE WHEN ok THEN verb END AS shape, is_anomaly FROM lines),
bare AS (
  SELECT window_id, coalesce(min(t), 'Infinity'::DOUBLE) AS start_time, count(*) AS record_count, count(*) FILTER (WHERE is_anomaly) AS anomalous_record_count, bool_or(is_anomaly) AS is_anomaly
  FROM rec GROUP BY 1),
runs AS (SELECT start_time AS t, CAST(sum(count(*)) OVER (ORDER BY start_time) AS BIGINT) AS upto FROM bare GROUP BY start_time),
cuts AS (
  SELECT min(t) FILTER (WHERE upto > floor((SELECT count(*) FROM bare) * 0.6::DOUBLE)) AS t1, min(t) FILTER (WHERE upto > floor((SELECT count(*) FROM bare) * 0.8::DOUBLE)) AS t2 FROM runs),
win AS (SELECT bare.*, CASE WHEN start_time < t1 THEN 'train' WHEN start_time < t2 THEN 'calibration' ELSE 'test' END AS split FROM bare, cuts),
known AS (SELECT DISTINCT shape FROM rec JOIN win USING (window_id) WHERE split = 'train' AND shape IS NOT NULL),
mat AS (SELECT rec.*, split, coalesce(known.shape, '?') AS template FROM rec JOIN win USING (window_id) LEFT JOIN known ON rec.shape = known.shape),
freq AS (SELECT template, count(*) AS n FROM mat WHERE split = 'train' GROUP BY 1),
freq_all AS (SELECT * FROM freq UNION ALL SELECT '?', 0 WHERE NOT EXISTS (SELECT 1 FROM freq WHERE template = '?')),
fit AS (SELECT template, ln((n + 1.0::DOUBLE) / ((SELECT sum(n) FROM freq_all) + 1.0::DOUBLE * (SELECT count(*) FROM freq_all))) AS log_p FROM freq_all),
sc AS (SELECT window_id, round(avg(-log_p), 9) AS score, bool_or(template = '?') AS has_unknown_template FROM mat JOIN fit USING (template) GROUP BY 1),
scored AS (SELECT * FROM win JOIN sc USING (window_id)),
cal AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM scored WHERE split = 'calibration'),
tau AS (SELECT score AS threshold FROM cal WHERE r = least(n, CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT)))"""


_OUT = "SELECT window_id, split, record_count, anomalous_record_count, has_unknown_template, is_anomaly, round(score, 6) AS score, CASE WHEN score > threshold THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS decision FROM scored, tau"
ORACLES = {
    "raw_fixed_slice": sql(_chain("'raw_window_' || lpad(CAST((line_number - 1) // 5 AS VARCHAR), 7, '0')").replace("coalesce(min(t), ", "coalesce(arg_min(t, line_number) FILTER (WHERE t IS NOT NULL), "), _OUT),
    "raw_session_slice": sql(_chain("'raw_blk_' || user_id"), _OUT),
}
