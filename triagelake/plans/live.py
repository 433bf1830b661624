"""Streaming queries, run to the end of a file stream and read back from their sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, scratch_dir
from triagelake.operators import calibration as cal
from triagelake.operators import monitoring as mon
from triagelake.operators import parse, scorers, templates, windows
from triagelake.operators import registry as reg
from triagelake.plans import base, chain
from triagelake.plans.audit import _PSI
from triagelake.plans.base import ALPHA, RECORDS, rounded, sql
from triagelake.plans.ingest import MASKED, _TEMPLATES, _parsed_stage
from triagelake.plans.scoring import _CAL
from triagelake.sources import tables
from triagelake.streaming import triage


def _file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = tables.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all files there are and read its sink."""
    spark, run = stream.sparkSession, uuid.uuid4().hex
    out = f"{scratch_dir(spark)}/sink-{run}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{scratch_dir(spark)}/state-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _timed(e: DataFrame) -> DataFrame:
    """Records with their event time as a timestamp, for the watermark."""
    return tables.as_records(e).withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")))


def stream_parse(spark, sf):
    """Frozen match of streamed lines against templates mined from the table."""
    fitted = materialize(templates.mine_templates(_parsed_stage(spark, sf), shape="shape"), "dictionary")
    lines = tables.as_lines(_file_stream(spark, sf, "events"))
    return rounded(_drain(triage.parse_stream(lines, fitted, "hdfs").select("line_number", "template_id", "template")))


def stream_parse_versions(spark, sf):
    """Streamed lines against the latest of two registered dictionaries, both mined on early lines only.

    The last tenth prints another verb, which no dictionary knows.
    """
    lines, _ = chain._lines(spark, sf)
    # the dictionaries differ in their lines only, so lines are parsed and masked once
    parsed = materialize(templates.with_shape(parse.parse_lines(lines, "hdfs")).select("line_number", "content", "shape"), "parsed")
    n = lines.count()
    run, root = uuid.uuid4().hex, scratch_dir(spark)
    for seq, (name, share) in enumerate((("first", 0.001), ("train", 0.6)), 1):
        early = parsed.filter(F.col("line_number") <= n * F.lit(share))
        reg.register(templates.mine_templates(early, shape="shape").withColumn("seq", F.lit(seq)), f"{root}/dictionaries-{run}", name)
    late = F.col("line_number") > n * F.lit(chain.LATE_SHARE)
    live = tables.as_lines(_file_stream(spark, sf, "events")).withColumn("raw_text", F.when(late, F.replace(F.col("raw_text"), F.lit("Handled view"), F.lit("Refused view"))).otherwise(F.col("raw_text")))
    query = live.writeStream.foreachBatch(triage.parse_per_batch(f"{root}/dictionaries-{run}", f"{root}/parsed-{run}", "hdfs")).option("checkpointLocation", f"{root}/state-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/parsed-{run}").select("line_number", (F.col("template_id") >= 0).alias("known"), "dictionary"))


def stream_sessions(spark, sf):
    e = _file_stream(spark, sf, "events")
    s = _drain(triage.stream_session_windows(_timed(e), "6 hours", "1 hour"))
    return rounded(s.select("session_id", "record_count", "start_time", "end_time", "first_line", "last_line", "anomalous_record_count"), keep=("start_time", "end_time"))


def stream_gate(spark, sf):
    w = base.event_windows(spark, sf)
    fit = scorers.fit_frequency(windows.sequence_counts(w.filter(F.col("split") == "train")))
    s = scorers.attach_scores(w.filter(F.col("split") == "calibration"), scorers.frequency_scores(windows.sequence_counts(w), fit))
    tau = cal.threshold_map(s, [ALPHA])[ALPHA]
    live = triage.stream_scored_windows(_timed(_file_stream(spark, sf, "events")), fit, base.WINDOW_SIZE, "events")
    done = _drain(cal.gate(live, tau))
    return rounded(done.select("window_id", "record_count", "anomalous_record_count", "score", "decision"))


def stream_drift(spark, sf):
    s = base.scored_stage(spark, sf)
    ref = s.filter(F.col("split") == "calibration")
    run = uuid.uuid4().hex
    root = scratch_dir(spark)
    s.select("window_id", "score").write.parquet(f"{root}/scores-{run}")
    stream = spark.readStream.schema("window_id string, score double").parquet(f"{root}/scores-{run}")
    query = stream.writeStream.foreachBatch(triage.drift_per_batch(ref, f"{root}/drift-{run}")).option("checkpointLocation", f"{root}/state-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/drift-{run}").select("sample_size", "reference_sample_size", "psi", "current_escalation_rate"))


def stream_reviews(spark, sf):
    o = _file_stream(spark, sf, "orders")
    status = F.col("o_orderstatus")
    r = o.select(
        F.concat(F.lit("inc_"), F.col("o_custkey")).alias("incident_id"), F.col("o_orderpriority").alias("reviewer_id"), F.lit("ESCALATE").alias("machine_decision"),
        F.when(status == "F", "CONFIRM").when(status == "O", "REJECT").otherwise("NEEDS_REVIEW").alias("human_decision"), F.lit(None).cast("string").alias("reason"),
        F.struct("o_orderdate", "o_orderkey").alias("ts"),
    )
    run, root = uuid.uuid4().hex, scratch_dir(spark)
    query = r.writeStream.foreachBatch(triage.reviews_per_batch(f"{root}/reviews-{run}")).option("checkpointLocation", f"{root}/state-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = mon.latest_reviews(spark.read.parquet(f"{root}/reviews-{run}"))
    return latest.select("incident_id", "reviewer_id", "human_decision", F.col("ts.o_orderkey").alias("seq"))


QUERIES = {f.__name__: f for f in (stream_parse, stream_parse_versions, stream_sessions, stream_gate, stream_drift, stream_reviews)}

ORACLES = {
    "stream_parse_versions": sql(chain._LINES.strip().rstrip(","), """
SELECT line_number, coalesce(ok AND verb IN (SELECT verb FROM lines WHERE ok AND line_number <= (SELECT count(*) FROM events) * 0.6::DOUBLE), false) AS known, CAST(2 AS BIGINT) AS dictionary FROM lines"""),
    "stream_parse": sql(MASKED + _TEMPLATES, "SELECT l.line_number, coalesce(template_id, -1) AS template_id, coalesce(template, 'UNKNOWN') AS template FROM lines l LEFT JOIN shaped s USING (line_number) LEFT JOIN tmpl ON s.masked = template"),
    "stream_sessions": sql(RECORDS + """,
g AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER w > 21600 THEN 1 WHEN lag(ts_s) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM rec WINDOW w AS (PARTITION BY session_id ORDER BY line_number)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY line_number) AS sid FROM g)""", """
SELECT session_id, count(*) AS record_count, min(ts_s) AS start_time, max(ts_s) AS end_time, min(line_number) AS first_line, max(line_number) AS last_line, count(*) FILTER (WHERE is_anomaly) AS anomalous_record_count
FROM n GROUP BY session_id, sid HAVING max(ts_s) + 21600 <= (SELECT max(ts_s) FROM rec) - 3600"""),
    "stream_gate": sql(_CAL, "SELECT window_id, record_count, anomalous_record_count, round(score, 6) AS score, CASE WHEN score > threshold THEN 'ESCALATE' ELSE 'AUTO-CLEAR' END AS decision FROM scored0, tau WHERE alpha = 0.05::DOUBLE"),
    "stream_drift": sql(_PSI.replace("cur AS (SELECT score FROM scored0 WHERE split = 'test')", "cur AS (SELECT score FROM scored0)"),
        "SELECT (SELECT count(*) FROM cur) AS sample_size, (SELECT count(*) FROM ref) AS reference_sample_size, round(sum((cp - rp) * ln(cp / rp)), 4) AS psi, round((SELECT avg(CAST(score > t AS INTEGER)) FROM cur, tt), 4) AS current_escalation_rate FROM sh"),
    "stream_reviews": """
SELECT 'inc_' || o_custkey AS incident_id, o_orderpriority AS reviewer_id, CASE o_orderstatus WHEN 'F' THEN 'CONFIRM' WHEN 'O' THEN 'REJECT' ELSE 'NEEDS_REVIEW' END AS human_decision, o_orderkey AS seq
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
}
