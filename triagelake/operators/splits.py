"""Chronological split without a global sort, its checks, and leakage guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.scale import order_positions, running_totals

SPLITS = ("train", "calibration", "test")
INF = float("inf")

# fixed values: strings that must not occur in searchable text
LABEL_INDICATORS = (
    "is_anomaly",
    "anomaly_label",
    "ground_truth",
    "is_anomaly=true",
    "is_anomaly=false",
    "label: anomaly",
    "label: normal",
)

# fixed values: field names that must not reach the reasoning stage
FORBIDDEN_FIELDS = ("is_anomaly", "anomaly_label", "ground_truth", "label", "target", "y_true", "true_label")


class LeakageError(ValueError):
    """A split or a field is used where it must not be."""


def _check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {tuple(ratios)}")


def _start() -> Column:
    return F.coalesce(F.col("start_time"), F.lit(INF))


def chronological_cuts(windows: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2)) -> tuple[float, float]:
    """Start times at which calibration and test begin.

    Works on the table of distinct start times with counts. A cut that falls inside a run of
    equal times moves to the start of the run, or behind it if the run is the first one.
    """
    _check_ratios(ratios)
    start = F.coalesce(F.col("start_time"), F.lit(INF)).alias("t")
    runs = windows.groupBy(start).agg(F.count(F.lit(1)).alias("c"))
    cum = running_totals(runs, "t", {"upto": "c"}).withColumn("below", F.col("upto") - F.col("c"))
    n = cum.agg(F.sum("c")).scalar()

    def cut(share: float) -> Column:
        target = F.floor(n * F.lit(share))
        usable = (F.col("upto") > target) & ((F.col("below") >= 1) | (target <= 0))
        return F.min(F.when(usable, F.col("t")))

    row = cum.agg(cut(ratios[0]).alias("a"), cut(ratios[0] + ratios[1]).alias("b"), F.sum("c").alias("n")).first()
    if not row["n"]:
        raise ValueError("cannot split an empty window table")
    return (INF if row["a"] is None else row["a"], INF if row["b"] is None else row["b"])


def assign_split(windows: DataFrame, cuts: tuple[float, float]) -> DataFrame:
    start = F.coalesce(F.col("start_time"), F.lit(INF))
    return windows.withColumn(
        "split",
        F.when(start < F.lit(cuts[0]), "train").when(start < F.lit(cuts[1]), "calibration").otherwise("test"),
    )


def chronological_split(windows: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2), snap: bool = True) -> DataFrame:
    """Add ``split``. Without ``snap``, or if all times are equal, the cut is by exact rank."""
    if snap:
        ends = windows.agg(F.min(_start()).alias("lo"), F.max(_start()).alias("hi")).first()
        if ends["lo"] is None or ends["lo"] < ends["hi"]:
            return assign_split(windows, chronological_cuts(windows, ratios))
    _check_ratios(ratios)
    keyed = windows.withColumn("_t", F.coalesce("start_time", F.lit(INF)))
    ranked = order_positions(keyed, "_t", "first_line", out="_pos")
    n = windows.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(
        "split",
        F.when(F.col("_pos") < F.floor(n * F.lit(ratios[0])), "train")
        .when(F.col("_pos") < F.floor(n * F.lit(ratios[0] + ratios[1])), "calibration")
        .otherwise("test"),
    ).drop("_t", "_pos")


def normal_subsplit(train: DataFrame, val_ratio: float = 0.1) -> DataFrame:
    """Normal TRAIN windows with ``subset`` fit / validation; the last share validates."""
    pool = train.filter(~F.col("is_anomaly")).withColumn("_t", F.coalesce("start_time", F.lit(INF)))
    n = pool.agg(F.count(F.lit(1))).scalar()
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(val_ratio)))
    ranked = order_positions(pool, "_t", "first_line", out="_pos")
    return ranked.withColumn("subset", F.when(F.col("_pos") < n - n_val, "fit").otherwise("validation")).drop("_t", "_pos")


def split_integrity(windows: DataFrame, strict: bool = True) -> DataFrame:
    """One row: ids and sessions in more than one split, time bounds, and whether all hold."""

    def shared(col: str) -> DataFrame:
        per_id = windows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        return per_id.agg(F.count_if(F.col("lo") != F.col("hi")).alias(f"shared_{col}s"))

    def bound(fn, split: str) -> Column:
        return fn(F.when(F.col("split") == split, F.col("start_time")))

    times = windows.agg(
        bound(F.max, "train").alias("max_train"),
        bound(F.min, "calibration").alias("min_calibration"),
        bound(F.max, "calibration").alias("max_calibration"),
        bound(F.min, "test").alias("min_test"),
    )

    def ordered(a: str, b: str) -> Column:
        ok = F.col(a) < F.col(b) if strict else F.col(a) <= F.col(b)
        return F.coalesce(ok, F.lit(True))

    out = times.withColumn("shared_window_ids", shared("window_id").scalar()).withColumn("shared_session_ids", shared("session_id").scalar())
    return out.withColumn("times_ordered", ordered("max_train", "min_calibration") & ordered("max_calibration", "min_test")).withColumn(
        "passed", F.col("times_ordered") & (F.col("shared_window_ids") == 0) & (F.col("shared_session_ids") == 0)
    )


def split_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("is_anomaly").alias("anomalous_windows"),
        F.count_if(~F.col("is_anomaly")).alias("normal_windows"),
    )


def corpus_leakage_audit(windows: DataFrame, retrieved_ids: DataFrame | None = None) -> DataFrame:
    """One row of pairwise id overlaps; ``retrieved_ids`` (window_id) must not meet TEST."""
    per_id = windows.groupBy("window_id").agg(*[F.bool_or(F.col("split") == s).alias(s) for s in SPLITS])
    if retrieved_ids is not None:
        seen = retrieved_ids.select("window_id").distinct().withColumn("_r", F.lit(True))
        per_id = per_id.join(seen, "window_id", "left").withColumn("retrieved", F.coalesce("_r", F.lit(False)))
    else:
        per_id = per_id.withColumn("retrieved", F.lit(False))
    out = per_id.agg(
        F.count_if(F.col("train") & F.col("calibration")).alias("train_calibration_overlap"),
        F.count_if(F.col("train") & F.col("test")).alias("train_test_overlap"),
        F.count_if(F.col("calibration") & F.col("test")).alias("calibration_test_overlap"),
        F.count_if(F.col("retrieved") & F.col("test")).alias("retrieval_test_overlap"),
    )
    total = sum((F.col(c) for c in out.columns), F.lit(0))
    return out.withColumn("passed", total == 0)


def quality_report(windows: DataFrame, records: DataFrame) -> DataFrame:
    """One row of data-quality counters over records and split windows."""
    rec = records.agg(
        F.count(F.lit(1)).alias("total_raw_records"),
        F.count_if(F.col("template_id") != -1).alias("parsed_records"),
        F.count_if(F.col("template_id") == -1).alias("unknown_template_records"),
        F.countDistinct(F.when(F.col("template_id") != -1, F.col("template_id"))).alias("unique_template_count"),
    )
    dup = windows.groupBy("window_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)))
    win = windows.agg(
        F.count(F.lit(1)).alias("total_windows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_windows") for s in SPLITS],
        F.count_if("is_anomaly").alias("anomalous_windows"),
        F.count_if(~F.col("is_anomaly")).alias("normal_windows"),
        F.count_if(F.col("start_time").isNull()).alias("missing_timestamps_count"),
    )
    for c in rec.columns:
        win = win.withColumn(c, rec.select(c).scalar())
    return win.withColumn("duplicate_window_ids_count", dup.scalar())


def quality_details(windows: DataFrame, records: DataFrame) -> DataFrame:
    """One row: leakage verdict, templates of TRAIN, records of later splits with a template TRAIN never had.

    ``records`` are (split, template_id); the vocabulary is a distinct set, joined by shuffle.
    """
    known = records.filter(F.col("split") == "train").select("template_id").distinct()
    seen = records.filter(F.col("template_id") != -1)
    # counted by template first, so that a frequent one is one row of the join
    later = seen.filter(F.col("split") != "train").groupBy("template_id").agg(F.count(F.lit(1)).alias("_n"))
    unseen = later.join(known, "template_id", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)))
    out = corpus_leakage_audit(windows).select(F.col("passed").alias("leakage_check_passed"))
    out = out.withColumn("train_unique_templates", known.filter(F.col("template_id") != -1).agg(F.count(F.lit(1))).scalar())
    return out.withColumn("later_records_unseen_in_train", unseen.scalar())


def require_split(split: str, allowed: Sequence[str]) -> str:
    """Refuse a split by name before any plan is built."""
    if split.strip().lower() not in allowed:
        raise LeakageError(f"split {split!r} is not one of {tuple(allowed)}")
    return split.strip().lower()


def read_split(windows: DataFrame, split: str, evaluate: bool = False) -> DataFrame:
    """Rows of one split; TEST only opens with ``evaluate``. Prunes partitions of a split table."""
    return windows.filter(F.col("split") == require_split(split, SPLITS if evaluate else SPLITS[:2]))


def split_violations(df: DataFrame, allowed: Sequence[str] = ("train",)) -> DataFrame:
    """Rows whose own split column is outside ``allowed``."""
    return df.filter(~F.lower(F.trim("split")).isin(*allowed))


def label_leaks(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds a label indicator, with the first one found."""
    low = F.lower(F.col(text))
    found = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in LABEL_INDICATORS])
    return df.withColumn("indicator", found).filter(F.col("indicator").isNotNull())


def forbidden_fields(schema: T.DataType, names: Sequence[str] = FORBIDDEN_FIELDS, path: str = "") -> list[str]:
    """Paths of label-like fields at any depth of a schema; needs no data scan."""
    if isinstance(schema, T.StructType):
        here = [f"{path}{f.name}" for f in schema.fields if f.name.lower() in names]
        return here + [p for f in schema.fields for p in forbidden_fields(f.dataType, names, f"{path}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, names, path)
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, names, path)
    return []


def require_label_free(df: DataFrame, names: Sequence[str] = FORBIDDEN_FIELDS) -> DataFrame:
    found = forbidden_fields(df.schema, names)
    if found:
        raise LeakageError(f"label fields present: {found}")
    return df
