"""Streaming form of parse, window, score, gate and drift. The fitted state is static tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake.functions.scale import materialize, pin_small
from triagelake.operators import monitoring as mon
from triagelake.operators import parse, registry, templates
from triagelake.operators.scorers import UNKNOWN_TEMPLATE
from triagelake.operators.windows import fixed_window_key


def parse_stream(lines: DataFrame, template_table: DataFrame, dataset: str) -> DataFrame:
    """Stateless header parse and frozen template match of a stream of (line_number, raw_text)."""
    return templates.match_templates(parse.parse_lines(lines, dataset), template_table)


def parse_per_batch(dictionaries: str, out_path: str, dataset: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parses lines by the latest registered dictionary.

    ``dictionaries`` is a registry of template tables, each run with a ``seq``; the highest one is read
    anew for every micro-batch, so a dictionary fitted elsewhere is taken up without a restart. Rows name
    their version. A batch that is run again replaces its rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = registry.registered(batch.sparkSession, dictionaries)
        version = held.agg(F.max("seq")).first()[0]
        # parsed and masked once, though the match reads the lines twice
        parsed = materialize(templates.with_shape(parse.parse_lines(batch, dataset)), "batch-lines")
        found = templates.match_templates(parsed, held.filter(F.col("seq") == version).select("template_id", "template", "size"), shape="shape").drop("shape")
        found.withColumn("dictionary", F.lit(version)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return run


def stream_session_windows(records: DataFrame, gap: str, delay: str, time: str = "ts") -> DataFrame:
    """Session windows per key that close after ``gap`` without a record.

    Rows later than the watermark are dropped; the query progress counts them.
    """
    keyed = records.filter(F.col("session_id").isNotNull()).withWatermark(time, delay)
    out = keyed.groupBy(F.session_window(time, gap).alias("w"), "session_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"), F.count_if("is_anomaly").alias("anomalous_record_count"), F.bool_or(F.col("template_id") == UNKNOWN_TEMPLATE).alias("has_unknown_template"),
    )
    return out.select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[2:])


_WINDOW_OUT = "dataset string, window_id string, start_time double, end_time double, record_count long, anomalous_record_count long, score double, complete boolean"
#: the open windows of a block, an entry each; ``n`` is -1 for one that was emitted on timeout, ``due`` its time in ms
_WINDOW_STATE = "window_id array<string>, n array<long>, start array<double>, end array<double>, first array<long>, last array<long>, bad array<long>, surprise array<double>, due array<long>"
_STATE_COLUMNS = [c.split()[0] for c in _WINDOW_STATE.split(", ")]
#: consecutive windows that one group folds together
WINDOWS_PER_BLOCK = 2_000


def _sums(b: pd.DataFrame) -> pd.DataFrame:
    """One row per window of the records in ``b``."""
    by = b.assign(bad=b["is_anomaly"].eq(True).astype("int64")).groupby("window_id", sort=False)
    out = by.agg(n=("bad", "size"), bad=("bad", "sum"), surprise=("surprise", "sum"))
    timed = b[b["timestamp"].notna() & b["line_number"].notna()].sort_values("line_number").groupby("window_id", sort=False)
    lo, hi = timed.first(), timed.last()
    return out.assign(first=lo["line_number"], start=lo["timestamp"], last=hi["line_number"], end=hi["timestamp"])


def _merged(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Sums of the windows of two tables; where both have a first or a last line, ``a`` keeps an equal one."""
    if a.empty:
        return b
    both = pd.concat([a, b])
    by = both.groupby(level=0, sort=False)
    out = by.agg({"n": "sum", "bad": "sum", "surprise": "sum"})
    lo = both.sort_values("first", kind="stable").groupby(level=0, sort=False).first()
    hi = both.sort_values("last", kind="stable", ascending=False).groupby(level=0, sort=False).first()
    return out.assign(first=lo["first"], start=lo["start"], last=hi["last"], end=hi["end"])


def _collect_window(size: int, min_size: int, patience_ms: int):
    """Fold the records of a block of windows into a few numbers each; emit those that are full, or late on timeout."""

    def rows(dataset: str, w: pd.DataFrame, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({
            "dataset": dataset, "window_id": w.index, "start_time": w["start"].to_numpy(), "end_time": w["end"].to_numpy(), "record_count": w["n"].to_numpy(),
            "anomalous_record_count": w["bad"].to_numpy(), "score": [round(s / n, 9) for s, n in zip(w["surprise"], w["n"], strict=True)], "complete": complete,
        })

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = dict(zip(_STATE_COLUMNS, state.get, strict=True)) if state.exists else {c: [] for c in _STATE_COLUMNS}
        held = pd.DataFrame({c: pd.Series(v, dtype=object if c == "window_id" else "Int64" if c in ("n", "first", "last", "bad", "due") else "float64") for c, v in held.items()}).set_index("window_id")
        new = held.iloc[:0].drop(columns="due")
        if not state.hasTimedOut:
            for b in batches:
                new = _merged(new, _sums(b))
        over = held["n"] < 0  # emitted on timeout; its stragglers can't change it
        touched = held.index.isin(new.index)
        held.loc[over & touched, "due"] = now + patience_ms
        new = new[~new.index.isin(held.index[over])]
        grown = _merged(held[touched & ~over].drop(columns="due"), new)
        full = grown["n"] >= size
        if full.any():
            yield rows(key[0], grown[full], True)
        seen = (grown["end"].fillna(0.0).astype("float64") * 1000).astype("int64").clip(lower=now)
        grown = grown.assign(due=seen + patience_ms)[~full]
        rest = held[over | ~touched]
        late = rest["due"] < now
        kept, done = rest[~late], rest[late & (rest["n"] >= 0)]
        if (done["n"] >= min_size).any():
            yield rows(key[0], done[done["n"] >= min_size], False)
        held = pd.concat([t for t in (kept, grown, done.assign(n=-1, due=now + patience_ms)) if len(t)] or [kept])
        if held.empty:
            if state.exists:
                state.remove()
            return
        plain = lambda c: [None if pd.isna(v) else float(v) if c in ("start", "end", "surprise") else int(v) for v in held[c]]
        state.update((list(held.index), *[plain(c) for c in _STATE_COLUMNS[1:]]))
        state.setTimeoutTimestamp(max(int(held["due"].min()), now + 1))

    return step


def stream_scored_windows(records: DataFrame, frequency_fit: DataFrame, size: int, prefix: str, index: str = "line_number", min_size: int = 1, delay: str = "1 hour", patience_ms: int = 600_000, time: str = "ts") -> DataFrame:
    """Fixed windows with their frequency score.

    The window of a record follows from its line index, and the state is keyed by block of
    WINDOWS_PER_BLOCK windows: a group is one call, so windows are folded many at a time. It holds the sums of
    the block's open windows only; no source, however busy, gathers in one task. A window
    that never fills is emitted once the watermark passes its last record by ``patience_ms``; records that
    come within another ``patience_ms`` are dropped, so no window is emitted twice.
    """
    unknown = frequency_fit.filter(F.col("template_id") == UNKNOWN_TEMPLATE).first()["log_p"]
    scored = records.join(pin_small(frequency_fit), "template_id", "left").withColumn("surprise", -F.coalesce("log_p", F.lit(unknown)))
    keyed = scored.withColumn("window_id", fixed_window_key(F.col(index), size, prefix))
    block = F.floor((F.col(index) - 1) / (size * WINDOWS_PER_BLOCK)).alias("block")
    slim = keyed.withWatermark(time, delay).select("dataset", block, "window_id", "line_number", "timestamp", "is_anomaly", "surprise", time)
    return slim.groupBy("dataset", "block").applyInPandasWithState(_collect_window(size, min_size, patience_ms), _WINDOW_OUT, _WINDOW_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drift_per_batch(reference: DataFrame, out_path: str, score: str = "score") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes one drift verdict per micro-batch, in a folder of its own.

    A batch that is run again replaces what it wrote before.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            mon.drift_verdict(reference, batch, score=score).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return run


def reviews_per_batch(log_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the last review per key of the batch into a log.

    ``latest_reviews`` over the log is the current state; a batch that is run again replaces its rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        mon.latest_reviews(batch).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return run
