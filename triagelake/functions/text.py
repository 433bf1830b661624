"""Text helpers as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"

# fixed values: masking rules, applied in this order
SESSION_LOG_MASKS = (r"blk_-?\d+", r"(/[\w.\-]+)+", r"(\d+\.){3}\d+(:\d+)?", r"\b\d+\b")
ALERT_LOG_MASKS = (r"core\.\d+", r"0x[0-9a-fA-F]+", r"(\d+\.){3}\d+", r"\b\d+\b")


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def mask(col: Column, patterns: Sequence[str] = SESSION_LOG_MASKS) -> Column:
    """Replace variable fields by the wildcard, rule after rule."""
    for p in patterns:
        col = F.regexp_replace(col, p, WILDCARD)
    return col


def words(col: Column) -> Column:
    """Whitespace-separated tokens; an empty text has none."""
    return F.array_remove(F.split(strip(col), r"\s+"), "")  # only an empty text gives an empty token


def sha(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ':'."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def lower_key(col: Column) -> Column:
    return F.lower(F.trim(col))


def contains_any(col: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(col)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    return hit
