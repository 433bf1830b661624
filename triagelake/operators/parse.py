"""Header parsing and record-level rules. All stateless columns, so batch and stream share them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.text import strip

# fixed value: header layout "date time pid level component: content"
SESSION_LOG_HEADER = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Za-z]+)\s+([^:]+):\s+(.*)$"
SESSION_KEY = r"(blk_-?\d+)"
_SEPARATOR = "\x01"

# fixed values: the shapes of secrets, the first group is kept
SECRET_PATTERNS = (
    r"(?i)(bearer\s+)[A-Za-z0-9_\-\.]{10,}",
    r"(?i)(api[_-]?key\s*[:=]\s*['\"]?)[A-Za-z0-9_\-\.]{8,}['\"]?",
    r"(?i)(secret\s*[:=]\s*['\"]?)[A-Za-z0-9_\-\.]{8,}['\"]?",
    r"(?i)(password\s*[:=]\s*['\"]?)[^\s'\"]+['\"]?",
    r"(?i)(authorization\s*[:=]\s*['\"]?)[^\s'\"]+['\"]?",
    r"(?i)(token\s*[:=]\s*['\"]?)[A-Za-z0-9_\-\.]{8,}['\"]?",
)

# fixed values: field names whose whole value is a secret
SENSITIVE_FIELDS = (
    "api_key",
    "apikey",
    "secret",
    "password",
    "auth",
    "authorization",
    "token",
    "access_token",
    "refresh_token",
    "private_key",
)

# fixed value: file paths that a submitted line must not name
PATH_REFERENCE = r"(\.\.[/\\])|([a-zA-Z]:[/\\])|(^[/\\](etc|sys|proc|var|usr|bin|root))"

def session_key(*texts: Column) -> Column:
    """First block id in the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, SESSION_KEY, 1), F.lit("")) for t in texts])


def header_timestamp(date: Column, time: Column) -> Column:
    """Epoch seconds of ``yyMMdd HHmmss``; NULL if it is no valid time."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyMMdd HHmmss"))).cast("double")


def _place(lines: DataFrame) -> list[str]:
    """Where a line comes from: its number and, if known, its file and place among non-blank lines."""
    return ["line_number", *[c for c in ("file", "record_index") if c in lines.columns]]


def parse_session_lines(lines: DataFrame, dataset: str = "hdfs") -> DataFrame:
    """Header parse of session logs. A line that does not match stays, with NULL header fields."""
    lines = lines.select(*_place(lines), strip(F.col("raw_text")).alias("_line"))
    line = F.col("_line")
    # one pass of the pattern writes all six groups; a line that holds the separator itself takes one pass a group
    once = F.split(F.regexp_replace(line, SESSION_LOG_HEADER + r"[\s\S]*", _SEPARATOR.join(f"${i}" for i in range(1, 7))), _SEPARATOR)
    each = F.when(F.rlike(line, F.lit(SESSION_LOG_HEADER)), F.array(*[F.regexp_extract(line, SESSION_LOG_HEADER, i) for i in range(1, 7)])).otherwise(F.array(line))
    lines = lines.withColumn("_groups", F.when(F.contains(line, F.lit(_SEPARATOR)), each).otherwise(once))
    ok = F.size("_groups") == 6

    def group(i: int) -> Column:
        return F.when(ok, F.get("_groups", F.lit(i - 1)))

    return lines.select(
        F.lit(dataset).alias("dataset"),
        *_place(lines),
        header_timestamp(group(1), group(2)).alias("timestamp"),
        F.when(ok, F.concat_ws(" ", group(1), group(2))).alias("timestamp_str"),
        F.when(ok, session_key(group(6), line)).otherwise(session_key(line)).alias("session_id"),
        group(4).alias("log_level"),
        strip(group(5)).alias("component"),
        line.alias("raw_message"),
        group(6).alias("content"),
        F.lit(None).cast("boolean").alias("is_anomaly"),
    )


def parse_alert_lines(lines: DataFrame, dataset: str = "bgl") -> DataFrame:
    """Header parse of alert logs: ten whitespace fields, the first one '-' for normal."""
    line = strip(F.col("raw_text"))
    f = F.split(line, r"\s+", 10)
    ok = F.size(f) == 10

    def field(i: int) -> Column:
        return F.when(ok, F.get(f, F.lit(i)))

    return lines.select(
        F.lit(dataset).alias("dataset"),
        *_place(lines),
        field(1).try_cast("double").alias("timestamp"),
        field(4).alias("timestamp_str"),
        field(3).alias("session_id"),
        field(8).alias("log_level"),
        field(7).alias("component"),
        line.alias("raw_message"),
        field(9).alias("content"),
        F.when(ok, field(0) != "-").alias("is_anomaly"),
    )


def parse_lines(lines: DataFrame, dataset: str) -> DataFrame:
    """Dispatch by dataset; blank lines are skipped, line numbers are kept."""
    parsers = {"hdfs": parse_session_lines, "bgl": parse_alert_lines}
    if dataset.lower() not in parsers:
        raise ValueError(f"no parser for dataset {dataset!r}")
    return parsers[dataset.lower()](lines.filter(strip(F.col("raw_text")) != ""))


def parse_stats(parsed: DataFrame) -> DataFrame:
    known = F.col("template_id") != -1
    return parsed.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(known).alias("parsed_records"),
        F.count_if(~known).alias("unknown_records"),
        F.countDistinct(F.when(known, F.col("template_id"))).alias("unique_templates"),
    )


def submission_violations(
    lines: DataFrame, text: str = "raw_text", batch: str | None = None, max_lines: int = 500, max_chars: int = 4096
) -> DataFrame:
    """Per row, which submission rules its line breaks; with ``batch``, also the batch size rule.

    The batch size is an aggregate joined back, so a huge batch is counted, never collected.
    """
    col = F.col(text)
    rules = F.array_compact(
        F.array(
            F.when(col.isNull() | (strip(col) == ""), F.lit("blank_line")),
            F.when(F.length(col) > max_chars, F.lit("line_too_long")),
            F.when(F.rlike(col, F.lit(PATH_REFERENCE)), F.lit("path_reference")),
        )
    )
    out = lines.withColumn("violations", rules)
    if batch is None:
        return out
    sizes = lines.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    return (
        out.join(sizes, batch)
        .withColumn("violations", F.when(F.col("_n") > max_lines, F.array_append("violations", F.lit("batch_too_large"))).otherwise(F.col("violations")))
        .drop("_n")
    )


def redact(col: Column) -> Column:
    """Blank secrets in a text, keeping what introduces them."""
    for p in SECRET_PATTERNS:
        col = F.regexp_replace(col, p, "$1[REDACTED]")
    return col


def redact_nested(df: DataFrame, sensitive: Sequence[str] = SENSITIVE_FIELDS) -> DataFrame:
    """Blank sensitive fields and redact every other string, at any depth of the schema."""
    keys = {k.lower() for k in sensitive}

    def clean(value: Column, dtype: T.DataType, name: str) -> Column:
        if name.lower() in keys:
            return F.when(value.isNotNull(), F.lit("[REDACTED]"))
        if isinstance(dtype, T.StringType):
            return redact(value)
        if isinstance(dtype, T.StructType):
            inner = F.struct(*[clean(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in dtype.fields])
            return F.when(value.isNotNull(), inner)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda x: clean(x, dtype.elementType, ""))
        if isinstance(dtype, T.MapType):
            hidden = F.array(*[F.lit(k) for k in sorted(keys)])
            # a value that isn't text can't hold the mark, so it becomes NULL
            blank = F.lit("[REDACTED]") if isinstance(dtype.valueType, T.StringType) else F.lit(None)
            named = isinstance(dtype.keyType, T.StringType)
            return F.transform_values(value, lambda k, v: F.when(F.array_contains(hidden, F.lower(k)), blank).otherwise(clean(v, dtype.valueType, "")) if named else clean(v, dtype.valueType, ""))
        return value

    return df.select(*[clean(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])
