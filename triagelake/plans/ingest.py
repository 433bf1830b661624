"""Queries over parsing, templates, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import parse, splits, templates, windows
from triagelake.functions.scale import materialize, spread
from triagelake.functions.text import ALERT_LOG_MASKS, mask
from triagelake.plans import base
from triagelake.plans.base import RECORDS, WINDOWS, rounded, sql
from triagelake.sources import tables

LINES = """
ev AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
lines AS (
  SELECT event_id + 1 AS line_number,
    strftime(ts, '%y%m%d %H%M%S') || ' ' || user_id || ' INFO app.' || upper(event_type[1]) || event_type[2:] ||
    CASE WHEN user_id % 10 = 1 THEN ' ' ELSE ': ' END || 'Handled ' || event_type || ' from 10.0.0.' || (user_id % 256) || ':80 on /srv/' ||
    event_type || ' code ' || k || ' blk_' || user_id AS raw_text FROM ev),
parsed AS (
  SELECT line_number, raw_text, regexp_matches(raw_text, '^(\\d{6})\\s+(\\d{6})\\s+(\\d+)\\s+([A-Za-z]+)\\s+([^:]+):\\s+(.*)$') AS ok FROM lines),
grp AS (
  SELECT *, CASE WHEN ok THEN regexp_extract(raw_text, '^(\\d{6})\\s+(\\d{6})\\s+(\\d+)\\s+([A-Za-z]+)\\s+([^:]+):\\s+(.*)$', ['d','t','pid','level','component','content']) END AS g
  FROM parsed)""".replace("\\\\", "\\")

MASKED = LINES + r""",
shaped AS (
  SELECT line_number, g.content AS content,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(g.content, 'blk_-?\d+', '<*>', 'g'), '(/[\w.\-]+)+', '<*>', 'g'),
      '(\d+\.){3}\d+(:\d+)?', '<*>', 'g'), '\b\d+\b', '<*>', 'g') AS masked FROM grp WHERE ok)"""


def _parsed(spark, sf):
    return parse.parse_lines(tables.event_lines(spark, sf), "hdfs")


def _parsed_stage(spark, sf):
    """Parsed lines with their shape as a written table, for queries that mine and then match them."""
    e = spread(tables.table(spark, sf, "events"), "event_id", "ts", "user_id")
    p = templates.with_shape(parse.parse_lines(tables.as_lines(e), "hdfs"))
    return materialize(p.select("line_number", "content", "shape"), "parsed")


def parse_header_lines(spark, sf):
    p = _parsed(spark, sf)
    return p.select("line_number", F.col("timestamp").cast("long").alias("ts_s"), "timestamp_str", "session_id", "log_level", "component", "raw_message", "content")


def parse_alert_lines(spark, sf):
    p = parse.parse_lines(tables.event_alert_lines(spark, sf), "bgl")
    return p.select("line_number", F.col("timestamp").cast("long").alias("ts_s"), "timestamp_str", "session_id", "log_level", "component", "content", "is_anomaly")


def parse_stats(spark, sf):
    p = _parsed_stage(spark, sf)
    return parse.parse_stats(templates.match_templates(p, templates.mine_templates(p, shape="shape"), shape="shape"))


def mask_variables(spark, sf):
    p = _parsed(spark, sf).filter(F.col("content").isNotNull())
    return p.select("line_number", mask(F.col("content")).alias("masked"))


def mask_alert_variables(spark, sf):
    p = parse.parse_lines(tables.event_alert_lines(spark, sf), "bgl").filter(F.col("content").isNotNull())
    return p.select("line_number", mask(F.col("content"), ALERT_LOG_MASKS).alias("masked"))


def redact_secrets(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(parse.redact(F.col("text")), 256).alias("clean_sha256"), F.contains(parse.redact(F.col("text")), F.lit("[REDACTED]")).alias("redacted"))


def submission_rules(spark, sf):
    d = tables.table(spark, sf, "documents")
    v = parse.submission_violations(d, text="text", batch="source", max_lines=500)
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"))


def mine_templates(spark, sf):
    return rounded(templates.mine_templates(_parsed(spark, sf)))


def match_templates(spark, sf):
    p = _parsed_stage(spark, sf)
    m = templates.match_templates(p, templates.mine_templates(p, shape="shape"), shape="shape")
    return rounded(m.select("line_number", "template_id", "template"))


def template_catalog(spark, sf):
    return rounded(templates.template_catalog(tables.event_records(spark, sf)))


def mine_document_templates(spark, sf):
    lines = tables.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("content"))
    return rounded(templates.mine_templates(lines, masks=ALERT_LOG_MASKS))


_WCOLS = ["window_id", "record_count", "first_line", "last_line", "has_unknown_template", "anomalous_record_count", "is_anomaly"]


def fixed_windows(spark, sf):
    w = windows.fixed_windows(tables.event_records(spark, sf), base.WINDOW_SIZE, prefix="events")
    return w.select(*_WCOLS, "start_time", "end_time", F.array_join("template_ids", " ").alias("template_ids"))


def _sessions(spark, sf):
    r = tables.event_day_sessions(spark, sf)
    # labels exist for the sessions with a purchase, so that unmapped sessions occur
    labels = r.groupBy("session_id").agg(F.bool_or("is_anomaly").alias("is_anomaly"), F.bool_or(F.col("template_id") == 3).alias("m")).filter("m").drop("m")
    return windows.session_windows(r, labels, prefix="events_session"), r


def session_windows(spark, sf):
    w, _ = _sessions(spark, sf)
    return w.select(*_WCOLS, "session_id", "unmapped_label", "start_time", "end_time")


def session_order(spark, sf):
    w, _ = _sessions(spark, sf)
    return windows.window_order_key(w).select("window_id", F.col("order_key.t").alias("t"), F.col("order_key.l").alias("l"))


def session_positions(spark, sf):
    p = windows.with_session_window(tables.event_day_sessions(spark, sf), "events_session")
    return p.select("window_id", "line_number", F.col("pos").cast("long").alias("pos"), F.col("template_id").cast("long").alias("template_id"))


def session_sequences(spark, sf):
    p = windows.with_session_window(tables.event_records(spark, sf), "user")
    s = windows.bounded_sequences(p, ["template_id"], 100)
    return s.select("window_id", "segment", F.array_join("template_ids", " ").alias("template_ids"))


def session_prefixes(spark, sf):
    p = windows.session_prefix(tables.event_records(spark, sf), "user", 3)
    return p.select("window_id", "line_number", F.col("pos").cast("long").alias("pos"))


def split_chronological(spark, sf):
    return base.event_windows(spark, sf).select("window_id", "split")


def split_by_rank(spark, sf):
    w, _ = _sessions(spark, sf)
    return splits.chronological_split(w, snap=False).select("window_id", "split")


def split_normal_subset(spark, sf):
    w = base.event_windows(spark, sf)
    return splits.normal_subsplit(w.filter(F.col("split") == "train")).select("window_id", "subset")


def split_integrity(spark, sf):
    return splits.split_integrity(base.event_windows(spark, sf))


def split_summary(spark, sf):
    return splits.split_summary(base.event_windows(spark, sf))


def leakage_audit(spark, sf):
    w = base.event_windows(spark, sf)
    return splits.corpus_leakage_audit(w, w.filter(F.col("split") == "train").select("window_id"))


def quality_report(spark, sf):
    return splits.quality_report(base.event_windows(spark, sf), tables.event_records(spark, sf))


def quality_details(spark, sf):
    w = base.event_windows(spark, sf)
    return splits.quality_details(w, w.select("split", F.explode("template_ids").alias("template_id")))


def label_leak_scan(spark, sf):
    c = tables.table(spark, sf, "documents").withColumn("probe", F.concat_ws(" ", "text", F.when(F.col("source") == "src1", F.lit("Label: Normal"))))
    return splits.label_leaks(c, "probe").select("doc_id", "indicator")


QUERIES = {
    f.__name__: f
    for f in (
        parse_header_lines, parse_alert_lines, parse_stats, mask_variables, mask_alert_variables, redact_secrets, submission_rules, mine_templates,
        match_templates, template_catalog, mine_document_templates, fixed_windows, session_windows, session_order, session_positions, session_sequences,
        session_prefixes, split_chronological, split_by_rank, split_normal_subset, split_integrity, split_summary, leakage_audit, quality_report, quality_details, label_leak_scan,
    )
}

_SESS = RECORDS + """,
srec AS (SELECT *, session_id || ':' || strftime(make_timestamp(CAST(floor(ts_s * 1000000.0::DOUBLE) AS BIGINT)), '%Y-%m-%d') AS sid FROM rec),
sess AS (
  SELECT sid AS session_id, 'events_session_' || sid AS window_id, arg_min(ts_s, line_number) AS start_time, arg_max(ts_s, line_number) AS end_time,
         count(*) AS record_count, min(line_number) AS first_line, max(line_number) AS last_line, bool_or(template_id = -1) AS has_unknown_template,
         count(*) FILTER (WHERE is_anomaly) AS anomalous_record_count, bool_or(is_anomaly) AND bool_or(template_id = 3) AS is_anomaly,
         NOT bool_or(template_id = 3) AS unmapped_label
  FROM srec GROUP BY sid)"""

_SECRETS = "text"
for _p, _f in (
    (r"(bearer\s+)[A-Za-z0-9_\-\.]{10,}", "gi"),
    (r"(api[_-]?key\s*[:=]\s*[''\"]?)[A-Za-z0-9_\-\.]{8,}[''\"]?", "gi"),
    (r"(secret\s*[:=]\s*[''\"]?)[A-Za-z0-9_\-\.]{8,}[''\"]?", "gi"),
    (r"(password\s*[:=]\s*[''\"]?)[^\s''\"]+[''\"]?", "gi"),
    (r"(authorization\s*[:=]\s*[''\"]?)[^\s''\"]+[''\"]?", "gi"),
    (r"(token\s*[:=]\s*[''\"]?)[A-Za-z0-9_\-\.]{8,}[''\"]?", "gi"),
):
    _SECRETS = f"regexp_replace({_SECRETS}, '{_p}', '\\1[REDACTED]', '{_f}')"

_TEMPLATES = """,
tmpl AS (SELECT masked AS template, CAST(row_number() OVER (ORDER BY masked) AS BIGINT) AS template_id FROM (SELECT DISTINCT masked FROM shaped))"""

ORACLES = {
    "parse_header_lines": sql(LINES, r"""
SELECT line_number, CASE WHEN ok THEN CAST(epoch(strptime(g.d || ' ' || g.t, '%y%m%d %H%M%S')) AS BIGINT) END AS ts_s,
  CASE WHEN ok THEN g.d || ' ' || g.t END AS timestamp_str, nullif(regexp_extract(raw_text, '(blk_-?\d+)', 1), '') AS session_id,
  CASE WHEN ok THEN g.level END AS log_level, CASE WHEN ok THEN g.component END AS component, raw_text AS raw_message,
  CASE WHEN ok THEN g.content END AS content FROM grp"""),
    "parse_alert_lines": r"""
WITH ev AS (SELECT *, json_extract_string(props, '$.k') AS k, event_type <> 'signup' AS ok FROM events)
SELECT event_id + 1 AS line_number, CASE WHEN ok THEN CAST(floor(epoch_us(ts) / 1000000.0::DOUBLE) AS BIGINT) END AS ts_s,
  CASE WHEN ok THEN strftime(ts, '%Y-%m-%d-%H.%M.%S') END AS timestamp_str, CASE WHEN ok THEN 'R' || (user_id % 64) END AS session_id,
  CASE WHEN ok THEN 'INFO' END AS log_level, CASE WHEN ok THEN 'KERNEL' END AS component,
  CASE WHEN ok THEN 'core.' || k || ' ' || event_type || ' parity error' END AS content,
  CASE WHEN ok THEN event_type = 'error' AND value > 100 END AS is_anomaly FROM ev""",
    "parse_stats": sql(MASKED, "SELECT (SELECT count(*) FROM lines) AS total_records, count(*) AS parsed_records, (SELECT count(*) FROM lines) - count(*) AS unknown_records, count(DISTINCT masked) AS unique_templates FROM shaped"),
    "mask_variables": sql(MASKED, "SELECT line_number, masked FROM shaped"),
    "mask_alert_variables": r"""SELECT event_id + 1 AS line_number, '<*> ' || event_type || ' parity error' AS masked FROM events WHERE event_type <> 'signup'""",
    "redact_secrets": f"WITH r AS (SELECT doc_id, {_SECRETS} AS clean FROM documents) SELECT doc_id, sha256(clean) AS clean_sha256, contains(clean, '[REDACTED]') AS redacted FROM r",
    "submission_rules": r"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text, E' \t\n\r') = '' THEN 'blank_line' END, CASE WHEN length(text) > 4096 THEN 'line_too_long' END,
  CASE WHEN regexp_matches(text, '(\.\.[/\\])|([a-zA-Z]:[/\\])|(^[/\\](etc|sys|proc|var|usr|bin|root))') THEN 'path_reference' END,
  CASE WHEN n > 500 THEN 'batch_too_large' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents JOIN n USING (source)""",
    "mine_templates": sql(MASKED + _TEMPLATES, "SELECT template_id, template, count(*) AS size FROM shaped JOIN tmpl ON masked = template GROUP BY ALL"),
    "match_templates": sql(MASKED + _TEMPLATES, "SELECT l.line_number, coalesce(template_id, -1) AS template_id, coalesce(template, 'UNKNOWN') AS template FROM lines l LEFT JOIN shaped s USING (line_number) LEFT JOIN tmpl ON s.masked = template"),
    "template_catalog": sql(RECORDS, "SELECT CAST(template_id AS BIGINT) AS template_id, template, count(*) AS size FROM rec WHERE template_id <> -1 GROUP BY ALL"),
    "fixed_windows": sql(WINDOWS, "SELECT window_id, record_count, first_line, last_line, false AS has_unknown_template, anomalous_record_count, is_anomaly, start_time, end_time, array_to_string(template_ids, ' ') AS template_ids FROM win"),
    "session_windows": sql(_SESS, "SELECT window_id, record_count, first_line, last_line, has_unknown_template, anomalous_record_count, is_anomaly, session_id, unmapped_label, start_time, end_time FROM sess"),
    "session_order": sql(_SESS, "SELECT window_id, start_time AS t, first_line AS l FROM sess"),
    "session_positions": sql(_SESS, "SELECT 'events_session_' || sid AS window_id, line_number, row_number() OVER (PARTITION BY sid ORDER BY ts_s, line_number) - 1 AS pos, CAST(template_id AS BIGINT) AS template_id FROM srec"),
    "session_sequences": sql(RECORDS + ", p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_s, line_number) - 1 AS pos FROM rec)",
        "SELECT 'user_' || session_id AS window_id, pos // 100 AS segment, array_to_string(list(template_id ORDER BY pos), ' ') AS template_ids FROM p GROUP BY ALL"),
    "session_prefixes": sql(RECORDS + ", p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_s, line_number) - 1 AS pos FROM rec)",
        "SELECT 'user_' || session_id AS window_id, line_number, pos FROM p WHERE pos < 3"),
    "split_chronological": sql(WINDOWS, "SELECT window_id, split FROM win"),
    "split_by_rank": sql(_SESS + ", r AS (SELECT window_id, row_number() OVER (ORDER BY start_time, first_line) - 1 AS pos, count(*) OVER () AS n FROM sess)",
        "SELECT window_id, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'calibration' ELSE 'test' END AS split FROM r"),
    "split_normal_subset": sql(WINDOWS + ", r AS (SELECT window_id, row_number() OVER (ORDER BY start_time, first_line) - 1 AS pos, count(*) OVER () AS n FROM win WHERE split = 'train' AND NOT is_anomaly)",
        "SELECT window_id, CASE WHEN pos < n - greatest(1, floor(n * 0.1::DOUBLE)) THEN 'fit' ELSE 'validation' END AS subset FROM r"),
    "split_integrity": sql(WINDOWS, """
SELECT max(start_time) FILTER (WHERE split = 'train') AS max_train, min(start_time) FILTER (WHERE split = 'calibration') AS min_calibration,
  max(start_time) FILTER (WHERE split = 'calibration') AS max_calibration, min(start_time) FILTER (WHERE split = 'test') AS min_test,
  CAST(0 AS BIGINT) AS shared_window_ids, CAST(0 AS BIGINT) AS shared_session_ids, true AS times_ordered, true AS passed FROM win"""),
    "split_summary": sql(WINDOWS, "SELECT split, count(*) AS total_windows, count(*) FILTER (WHERE is_anomaly) AS anomalous_windows, count(*) FILTER (WHERE NOT is_anomaly) AS normal_windows FROM win GROUP BY 1"),
    "leakage_audit": sql(WINDOWS, """
SELECT (SELECT count(*) FROM (SELECT window_id FROM win WHERE split = 'train' INTERSECT SELECT window_id FROM win WHERE split = 'calibration')) AS train_calibration_overlap,
  (SELECT count(*) FROM (SELECT window_id FROM win WHERE split = 'train' INTERSECT SELECT window_id FROM win WHERE split = 'test')) AS train_test_overlap,
  (SELECT count(*) FROM (SELECT window_id FROM win WHERE split = 'calibration' INTERSECT SELECT window_id FROM win WHERE split = 'test')) AS calibration_test_overlap,
  CAST(0 AS BIGINT) AS retrieval_test_overlap, true AS passed"""),
    "quality_report": sql(WINDOWS, """
SELECT count(*) AS total_windows, count(*) FILTER (WHERE split = 'train') AS train_windows, count(*) FILTER (WHERE split = 'calibration') AS calibration_windows,
  count(*) FILTER (WHERE split = 'test') AS test_windows, count(*) FILTER (WHERE is_anomaly) AS anomalous_windows, count(*) FILTER (WHERE NOT is_anomaly) AS normal_windows,
  count(*) FILTER (WHERE start_time IS NULL) AS missing_timestamps_count, (SELECT count(*) FROM rec) AS total_raw_records, (SELECT count(*) FROM rec WHERE template_id <> -1) AS parsed_records,
  (SELECT count(*) FROM rec WHERE template_id = -1) AS unknown_template_records, (SELECT count(DISTINCT template_id) FROM rec) AS unique_template_count,
  count(*) - count(DISTINCT window_id) AS duplicate_window_ids_count FROM win"""),
    "quality_details": sql(WINDOWS, """
SELECT NOT EXISTS (SELECT window_id FROM win GROUP BY 1 HAVING count(DISTINCT split) > 1) AS leakage_check_passed,
  (SELECT count(DISTINCT template_id) FROM wrec JOIN win USING (window_id) WHERE split = 'train' AND template_id <> -1) AS train_unique_templates,
  (SELECT count(*) FROM wrec JOIN win USING (window_id) WHERE split <> 'train' AND template_id <> -1
    AND template_id NOT IN (SELECT template_id FROM wrec JOIN win USING (window_id) WHERE split = 'train')) AS later_records_unseen_in_train"""),
    "label_leak_scan": """
WITH p AS (SELECT doc_id, lower(text || CASE WHEN source = 'src1' THEN ' Label: Normal' ELSE '' END) AS low FROM documents)
SELECT doc_id, coalesce(CASE WHEN contains(low, 'is_anomaly') THEN 'is_anomaly' END, CASE WHEN contains(low, 'anomaly_label') THEN 'anomaly_label' END,
  CASE WHEN contains(low, 'ground_truth') THEN 'ground_truth' END, CASE WHEN contains(low, 'label: anomaly') THEN 'label: anomaly' END, CASE WHEN contains(low, 'label: normal') THEN 'label: normal' END) AS indicator
FROM p WHERE indicator IS NOT NULL""",
}
