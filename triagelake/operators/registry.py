"""Append-only registry of runs, and thresholds that are frozen once and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import calibration as cal


def register(rows: DataFrame, path: str, run_id: str) -> bool:
    """Append the rows of a run to the registry at ``path``; a run that is there already changes nothing.

    A run is one folder, which appears whole when its write is committed. So a job that is run again, or
    two that register the same run, leave one set of rows. Returns whether rows were added.
    """
    spark = rows.sparkSession
    target = f"{path}/run_id={run_id}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    rows.drop("run_id").write.mode("overwrite").parquet(target)
    return True


def registered(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all runs with their run_id."""
    return spark.read.option("basePath", path).parquet(f"{path}/run_id=*").withColumn("run_id", F.col("run_id").cast("string"))


def latest(registry: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; of equal ones the greatest run_id."""
    last = F.max_by(F.struct(*registry.columns), F.struct(*order, "run_id"))
    return registry.groupBy(*keys).agg(last.alias("_l")).select("_l.*")


def threshold_rows(calibration: DataFrame, systems: Sequence[str], quantile: float = 0.95, alphas: Sequence[float] = cal.ALPHA_GRID) -> DataFrame:
    """(dataset, system, rule, level, threshold, n): the quantile and the conformal thresholds of every system.

    ``systems`` are score columns of the calibration windows. The scores are unpivoted, so all systems and
    datasets are ordered in one pass each for the quantiles and the conformal ranks.
    """
    long = calibration.select("dataset", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("score")) for s in systems])))
    by = ["dataset", "system"]
    q = cal.quantile_threshold(long, quantile, by).select(*by, F.lit("quantile").alias("rule"), F.lit(quantile).alias("level"), "threshold", "n")
    c = cal.conformal_thresholds(long, alphas, by).select(*by, F.lit("conformal").alias("rule"), F.col("alpha").alias("level"), "threshold", F.col("n_calibration").alias("n"))
    return q.unionByName(c)


def classify_frozen(scored: DataFrame, thresholds: DataFrame, systems: Sequence[str], rule: str, level: float) -> DataFrame:
    """(dataset, window_id, split, system, pred): windows above the frozen threshold; NULL where none is frozen."""
    long = scored.select("dataset", "window_id", "split", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("score")) for s in systems])))
    t = thresholds.filter((F.col("rule") == rule) & (F.col("level") == level)).select("dataset", "system", "threshold")
    return long.join(t, ["dataset", "system"], "left").select("dataset", "window_id", "split", "system", (F.col("score") > F.col("threshold")).cast("int").alias("pred"))
