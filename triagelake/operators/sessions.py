"""Sessions of any length: transitions, scores and content hashes from long rows.

A record is a row (dataset, window_id, pos, ...). A session is cut into segments of consecutive positions,
each segment is the work of one group, and segments are stitched by what each knows of its last record or of
its digest. So a session with a third of all rows is many tasks, and no array holds a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, pin_small
from triagelake.functions.text import strip
from triagelake.operators.scorers import UNKNOWN_TOKEN

#: records of a segment, and digests that one digest covers
SEGMENT = 1_000
_KEY = ("dataset", "window_id")


def session_steps(positioned: DataFrame, vocab: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(dataset, window_id, prev, next, n): how often each token follows another in a window.

    A window's first token has no ``prev``. Inside a segment the one before is taken by a window function;
    the first record of a segment takes the last token of the segment before it. Templates outside the
    vocabulary, nulls too, share one token.
    """
    token = F.coalesce("idx", F.lit(UNKNOWN_TOKEN))
    rows = positioned.select(*_KEY, "pos", "template_id").join(vocab, "template_id", "left").select(*_KEY, "pos", token.alias("next"), F.floor(F.col("pos") / segment).alias("segment"))
    inside = Window.partitionBy(*_KEY, "segment").orderBy("pos")
    placed = rows.withColumn("prev", F.lag("next").over(inside))
    ends = rows.groupBy(*_KEY, (F.col("segment") + 1).alias("segment")).agg(F.max_by("next", "pos").alias("_last"))
    starts = placed.filter(F.col("prev").isNull()).drop("prev").join(ends, [*_KEY, "segment"], "left").withColumnRenamed("_last", "prev")
    every = placed.filter(F.col("prev").isNotNull()).select(*_KEY, "prev", "next").unionByName(starts.select(*_KEY, "prev", "next"))
    return every.groupBy(*_KEY, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def fit_steps(steps: DataFrame, vocab_size: int, alpha: float = 1.0) -> dict:
    """The next-template model of these windows: as fitted on arrays, since every record is the ``next`` of one step."""
    uni = pin_small(steps.groupBy("next").agg(F.sum("n").alias("c")))
    pairs = pin_small(steps.filter(F.col("prev").isNotNull()).groupBy("prev", "next").agg(F.sum("n").alias("c")))
    denominator = float(uni.agg(F.sum("c")).first()[0] or 0) + alpha * vocab_size
    return {"probs": uni.select("next", ((F.col("c") + F.lit(alpha)) / F.lit(denominator)).alias("p")), "steps": pairs, "floor": alpha / denominator}


def step_scores(steps: DataFrame, model: dict, beta: float = 1.0) -> DataFrame:
    """Mean negative log-likelihood per window: of its steps, or of its one token where it has no step."""
    context = model["steps"].groupBy("prev").agg(F.sum("c").alias("ctx"))
    rows = steps.join(model["probs"], "next", "left").join(model["steps"], ["prev", "next"], "left").join(context, "prev", "left")
    p = (F.coalesce("c", F.lit(0)) + F.lit(beta) * F.coalesce("p", F.lit(model["floor"]))) / (F.coalesce("ctx", F.lit(0)) + F.lit(beta))
    step = F.col("prev").isNotNull()
    total = lambda when, x: F.sum(F.when(when, x))
    cost = -F.log(p) * F.col("n")
    out = rows.groupBy(*_KEY).agg(total(step, cost).alias("s"), total(step, F.col("n")).alias("n"), total(~step, cost).alias("alone"))
    return out.select(*_KEY, F.round(F.coalesce(F.col("s") / F.col("n"), F.col("alone")), 9).alias("score"))


def ordered_digest(positioned: DataFrame, item: Column, separator: str, segment: int = SEGMENT, name: str = "digest") -> DataFrame:
    """(dataset, window_id, ``name``): SHA-256 over a window's items in order, as a tree of segments.

    A leaf is the digest of up to ``segment`` stripped items joined by ``separator``; a node is the digest of
    up to ``segment`` digests joined by commas, until one is left. A window of one segment has the
    plain digest of its joined items, whatever other windows hold. A null item is left out.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "item")))  # at most ``segment`` items
    rows = positioned.select(*_KEY, "pos", strip(item).alias("item"))
    leaves = rows.groupBy(*_KEY, F.floor(F.col("pos") / segment).alias("idx")).agg(items.alias("i"))
    leaves = leaves.select(*_KEY, "idx", F.sha2(strip(F.array_join("i.item", separator)), 256).alias("digest"))
    nodes = materialize(leaves.withColumn("last", F.max("idx").over(Window.partitionBy(*_KEY))), "leaf-digests")
    while (nodes.agg(F.max("last")).first()[0] or 0) > 0:
        up = nodes.groupBy(*_KEY, F.floor(F.col("idx") / segment).alias("idx"), "last").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("d"))
        digest = F.when(F.col("last") == 0, F.get("d", F.lit(0))["digest"]).otherwise(F.sha2(F.array_join("d.digest", ","), 256))
        nodes = materialize(up.select(*_KEY, "idx", digest.alias("digest"), F.floor(F.col("last") / segment).alias("last")), "node-digests")
    return nodes.select(*_KEY, F.col("digest").alias(name))


def content_hashes(positioned: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(dataset, window_id, source_hash, template_hash) of the raw messages and of the template sequence."""
    known = F.concat(F.lit("template_"), F.col("template_id").cast("string"))
    template = F.when(F.col("template_id") >= 0, known).otherwise("template_unknown")
    source = ordered_digest(positioned, F.col("raw_message"), "\n", segment, "source_hash")
    return source.join(ordered_digest(positioned, template, " ", segment, "template_hash"), list(_KEY))


def template_terms(counts: DataFrame, key: str) -> DataFrame:
    """(dataset, key, token, tf) of (dataset, key, template_id, n) rows."""
    known = F.concat(F.lit("template_"), F.col("template_id").cast("string"))
    return counts.select("dataset", key, F.when(F.col("template_id") >= 0, known).otherwise("template_unknown").alias("token"), F.col("n").alias("tf")).groupBy("dataset", key, "token").agg(F.sum("tf").alias("tf"))
