"""Views of the driver tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the template id given to each event type
EVENT_TEMPLATES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as parsed log records. Timestamps are epoch seconds, ids follow file order."""
    return as_records(table(spark, sf_dir, "events"))


def as_records(e: DataFrame) -> DataFrame:
    template = F.lit(-1)
    for name, tid in EVENT_TEMPLATES.items():
        template = F.when(F.col("event_type") == name, tid).otherwise(template)
    return e.select(
        F.lit("events").alias("dataset"),
        (F.col("event_id") + 1).alias("line_number"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        template.cast("int").alias("template_id"),
        F.col("event_type").alias("template"),
        F.concat_ws(" ", "event_type", "props").alias("raw_message"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("is_anomaly"),
        F.col("value"),
        F.col("user_id"),
    )


def event_day_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records keyed by user and day, the session key of the session-window queries."""
    r = event_records(spark, sf_dir)
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd")
    return r.withColumn("session_id", F.concat_ws(":", "session_id", day))


def event_sessions(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """Event records keyed by user and span of ``days`` days: sessions of a dozen records and more."""
    r = event_records(spark, sf_dir)
    span = F.floor(F.col("timestamp") / F.lit(86_400 * days)).cast("string")
    return r.withColumn("session_id", F.concat_ws(":", "session_id", span))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` printed as header-plus-content log lines.

    Lines of users 1, 11, 21, ... lose their colon, so the malformed branch is exercised too.
    """
    return as_lines(table(spark, sf_dir, "events"))


def as_lines(e: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    component = F.concat(F.lit("app."), F.initcap("event_type"))
    sep = F.when(F.col("user_id") % 10 == 1, F.lit(" ")).otherwise(F.lit(": "))
    line = F.concat(
        F.date_format(ts, "yyMMdd HHmmss"), F.lit(" "), F.col("user_id"), F.lit(" INFO "), component, sep,
        F.lit("Handled "), F.col("event_type"), F.lit(" from 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(":80 on /srv/"),
        F.col("event_type"), F.lit(" code "), F.get_json_object("props", "$.k"), F.lit(" blk_"), F.col("user_id"),
    )
    return e.select((F.col("event_id") + 1).alias("line_number"), line.alias("raw_text"))


def event_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` printed as ten-field alert lines; sign-ups miss their content field."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    label = F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.lit("FATAL")).otherwise(F.lit("-"))
    node = F.concat(F.lit("R"), (F.col("user_id") % 64).cast("string"))
    content = F.when(F.col("event_type") == "signup", F.lit("")).otherwise(
        F.concat(F.lit(" core."), F.get_json_object("props", "$.k"), F.lit(" "), F.col("event_type"), F.lit(" parity error"))
    )
    line = F.concat(
        F.concat_ws(" ", label, F.unix_seconds(ts).cast("string"), F.date_format(ts, "yyyy.MM.dd"), node,
                    F.date_format(ts, "yyyy-MM-dd-HH.mm.ss"), node, F.lit("RAS"), F.lit("KERNEL"), F.lit("INFO")),
        content,
    )
    return e.select((F.col("event_id") + 1).alias("line_number"), line.alias("raw_text"))
