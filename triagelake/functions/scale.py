"""Distributed building blocks shared by the operators.

Nothing here sorts a whole table in one task. A global order is cut into buckets by approximate
quantiles; each bucket is ordered on its own and shifted by the total of the buckets before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIN_MAX_ROWS = 200_000
SINGLE_WINDOW_ROWS = 50_000
LINES_PER_BLOCK = 1_000_000
#: session setting that names the folder where spark.checkpoint.dir is unset
STAGE_DIR = "spark.triagelake.stage.dir"


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir``, or the one set for this session.

    Only a session whose executors share the driver's disk may fall back to a fresh local folder;
    any other has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGE_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir or {STAGE_DIR} to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="triagelake-")
        spark.conf.set(STAGE_DIR, path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a stage to Parquet and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_copy(df: DataFrame, max_rows: int) -> DataFrame | None:
    """The table as local rows of the plan, or None if it has more than ``max_rows`` rows.

    At most ``max_rows + 1`` rows reach the driver.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, schema=df.schema)


def pin_small(df: DataFrame, max_rows: int = PIN_MAX_ROWS) -> DataFrame:
    """Turn a fitted table into a broadcast local one if it has at most ``max_rows`` rows.

    A larger table is returned as it is, so the join that uses it stays a shuffle join.
    """
    local = local_copy(df, max_rows)
    return df if local is None else F.broadcast(local)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by ``by``: a compact file is few splits, too few where each row takes long."""
    return df.repartition(max(rank_buckets(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism), *by)


def rank_buckets(spark: SparkSession) -> int:
    """How many order buckets to cut: one per shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _numeric_order(df: DataFrame, key: str) -> Column:
    """``key`` itself, or for strings the number of its first seven bytes, which keeps the order."""
    if dict(df.dtypes)[key] != "string":
        return F.col(key)
    head = F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 7))
    return F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long")


def _with_cuts(df: DataFrame, key: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Add ``_cuts``: per group, the approximate quantiles of ``key``. Groups must be few."""
    probs = [i / buckets for i in range(1, buckets)]
    approx = F.sort_array(F.percentile_approx(_numeric_order(df, key), probs, 100 * buckets))  # NaN among the values upsets their order
    if not by:
        return df.withColumn("_cuts", df.agg(approx.alias("c")).scalar())
    per_group = df.groupBy(*by).agg(approx.alias("c"))
    entries = F.collect_list(F.struct(F.struct(*by).alias("k"), F.col("c").alias("v")))
    lookup = per_group.agg(F.map_from_entries(entries).alias("m")).scalar()
    return df.withColumn("_cuts", F.element_at(lookup, F.struct(*by)))


def _cuts_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ordered ``cuts``, ``most`` of them, lie below ``value``, by halving.

    ``value`` is worked out once a row; inside a filter it would be once a cut.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def halving(x: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(x["cuts"], at + s - 1) < x["value"], at + s).otherwise(at))

    found = F.get(F.transform(F.array(F.struct(cuts.alias("cuts"), value.alias("value"))), halving), F.lit(0))
    return F.when(cuts.isNull(), F.size(cuts)).otherwise(found)


def running_totals(
    df: DataFrame,
    key: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``key``; ``df`` has one row per (``by``, ``key``).

    ``sums`` maps output name to input column. ``by`` are group columns with few values. A table
    of up to SINGLE_WINDOW_ROWS rows takes one plain window; a larger one is cut into buckets.
    ``buckets`` forces the second way.
    """
    by = list(by)
    small = None if buckets else local_copy(df, SINGLE_WINDOW_ROWS)
    if small is not None:
        w = Window.partitionBy(*by).orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
        return small.select("*", *[F.sum(c).over(w).alias(o) for o, c in sums.items()])
    n = buckets or rank_buckets(df.sparkSession)
    placed = _with_cuts(df, key, by, n).withColumn(
        "_b", _cuts_below(F.col("_cuts"), _numeric_order(df, key), n - 1)
    ).drop("_cuts")
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    order = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    # at most (groups x buckets) rows, so this side is always small enough to broadcast
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), [*by, "_b"])
    return out.select(*df.columns, *[(F.col(f"_o_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()])


def order_positions(
    df: DataFrame,
    order: str,
    tiebreak: str,
    by: Sequence[str] = (),
    out: str = "pos",
    buckets: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside its group, in (``order``, ``tiebreak``) order.

    Groups of up to SINGLE_WINDOW_ROWS rows are ranked as they are, in one shuffle. A larger one, or the table
    without groups, is split into sub-groups along the order, ranked there, and shifted by the sizes of the earlier sub-groups. A single value of ``order`` that
    fills a whole bucket is split further by blocks of the integer ``tiebreak``.
    """
    by = list(by)
    if by and buckets is None:
        # a few rows at most: each stands for SINGLE_WINDOW_ROWS of the table
        large = pin_small(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SINGLE_WINDOW_ROWS).select(*by))
        plain = df if large.isEmpty() else df.join(large, by, "left_anti")
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, tiebreak))
        columns = [*by, *[c for c in df.columns if c not in by]]
        ranked = plain.dropna(subset=by).select(*columns, (rank - 1).cast("long").alias(out))
        if large.isEmpty():
            return ranked
        cut = order_positions(df.join(large, by, "left_semi"), order, tiebreak, by, out, rank_buckets(df.sparkSession))
        return ranked.unionByName(cut)
    n = buckets or rank_buckets(df.sparkSession)
    key = F.col(order)
    cut = _with_cuts(df, order, [], n)
    at_cut = F.array_contains("_cuts", key)
    placed = cut.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < key)) * 2 + at_cut.cast("int")).withColumn(
        "_s", F.when(at_cut, F.floor(F.col(tiebreak) / LINES_PER_BLOCK)).otherwise(F.lit(0)).cast("long")
    ).drop("_cuts")
    # a run equal to a cut sorts after the smaller values of its bucket
    sizes = placed.groupBy(*by, "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_b", "_s").orderBy(order, tiebreak)
    ranked = placed.withColumn("_r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*by, "_b", "_s"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_b", "_s", "_o", "_r")


def at_most(col: Column, low: float, high: float) -> Column:
    """Clip a column to [low, high]."""
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den`` as double; ``empty`` (NULL by default) where the denominator is 0."""
    fallback = F.lit(empty).cast("double")
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(fallback)
