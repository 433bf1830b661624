"""Benchmark passages in training texts, by spaced seeds. Only DataFrame functions on this path."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import only, write_stage

#: token positions that count, of a window of 8. However two tokens of a run of 12 are substituted,
#: one of these masks has a window in the run that none of its positions meets
MASKS = ("11101001", "11000111")
#: an overlap is at least this many aligned tokens (or the whole of a shorter item)
MIN_OVERLAP = 12
#: of the aligned tokens at most this share may be substituted
MAX_SUBSTITUTED = 0.2
#: seeds of the benchmark up to this number are broadcast (16 bytes each); more are joined by shuffle
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null or empty text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(hashes: Column, masks: Sequence[str] = MASKS) -> Column:
    """array<struct<pos, seed>>: for each window and mask the hash of the tokens that count.

    A text shorter than the window has one seed of all its tokens, at position 0, so that short
    items are still found: as a whole, in texts that are no longer than they.
    """
    span = len(masks[0])
    n = F.size(hashes)

    def window(i: Column) -> Column:
        at = lambda j: F.get(hashes, i + F.lit(j))
        return F.array(*[F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[at(j) for j, c in enumerate(m) if c == "1"]).alias("seed")) for k, m in enumerate(masks)])

    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.lit(-1), hashes).alias("seed")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))), window))
    return F.when(n >= span, every).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))


def length_masks(n: int, max_substituted: float = MAX_SUBSTITUTED) -> list[str]:
    """Masks of ``n`` tokens of which one misses all substituted tokens, wherever the allowed ones are.

    With s allowed, n is cut into s + 2 blocks, and each mask leaves out s of them.
    """
    spare = n - ceil(n * (1 - max_substituted))
    block = [j * (spare + 2) // n for j in range(n)]
    return list(dict.fromkeys("".join("0" if b in out else "1" for b in block) for out in combinations(range(spare + 2), spare)))


def own_seeds(hashes: Column, n: int, max_substituted: float = MAX_SUBSTITUTED) -> Column:
    """array<struct<pos, seed>> of all windows of ``n`` tokens, for whole items of that length."""
    at = lambda i, j: F.get(hashes, i + F.lit(j))
    masks = list(enumerate(length_masks(n, max_substituted)))
    window = lambda i: F.array(*[F.struct(i.alias("pos"), F.xxhash64(F.lit(f"{n}:{k}"), *[at(i, j) for j, c in enumerate(m) if c == "1"]).alias("seed")) for k, m in masks])
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0))), window))
    return F.when(F.size(hashes) >= n, every).otherwise(F.slice(every, 1, 0))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, min_overlap: int = MIN_OVERLAP, max_substituted: float = MAX_SUBSTITUTED, broadcast_seeds: int = BROADCAST_SEEDS, short_items: bool = True, min_tokens: int = 1) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): the best overlap of each document and item.

    Spaced seeds of both sides are joined; each hit fixes a diagonal (position in the document less
    position in the item). Around the hits of a diagonal the tokens are compared one by one: of every
    run of ``min_overlap`` aligned tokens (the whole item if it is shorter) the one with most equal
    tokens counts, and is reported if at most ``max_substituted`` of it differs. ``start`` is the
    document's first token of that run, ``n_tokens`` its length and ``n_equal`` its equal tokens.

    An item of fewer than ``min_overlap`` tokens is found anywhere in a text, with as many substitutions
    as allowed: documents get seeds at each such length that the benchmark has. So an item of one
    common word marks every text that has it; items of fewer than ``min_tokens`` tokens are left out.
    Without ``short_items`` short items have the seeds of the others and are found in part only.

    Null and empty texts and items have no overlaps, null ids are ids like others, equal rows give
    one overlap. The seeds of the benchmark are broadcast while they are few; else they are joined by
    a shuffle, to the same result. Candidates are counted per document, item and diagonal, so nothing
    is listed twice and no pair of documents is ever formed.
    """
    spark = docs.sparkSession
    items, _ = write_stage(_hashed(only(benchmark, "item_id", "text").distinct(), "item").select("item_id", "item").filter(F.size("item") >= max(1, min_tokens)), "items")
    n, lengths = F.size("item"), []
    if short_items:  # fewer than min_overlap numbers
        lengths = sorted(r[0] for r in items.filter(n < min_overlap).select(n).distinct().collect())

    def all_seeds(hashes: Column, of: Column | None = None) -> Column:
        usual = seeds(hashes, masks)
        if not lengths:
            return usual
        none = F.slice(usual, 1, 0)
        own = [own_seeds(hashes, m, max_substituted) for m in lengths]
        if of is not None:  # an item has the seeds of its own length only
            return reduce(lambda rest, x: F.when(of == x[0], x[1]).otherwise(rest), zip(lengths, own, strict=True), usual)
        return F.concat(F.when(F.size(hashes) >= len(masks[0]), usual).otherwise(none), *own)

    wanted, _ = write_stage(items.select("item_id", F.inline(all_seeds(F.col("item"), n))).select(F.col("seed"), "item_id", F.col("pos").alias("at")), "item-seeds")
    few = wanted.count() <= broadcast_seeds
    mine = _hashed(only(docs, "doc_id", "text"), "words").select("doc_id", F.inline(all_seeds(F.col("words"))))
    hits = mine.join(F.broadcast(wanted) if few else wanted, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "pos")
    # one row per diagonal: the hits a document has on it
    lines, _ = write_stage(hits.groupBy("doc_id", "item_id", "shift").agg(F.count(F.lit(1)).alias("n_hits")), "seed-hits")
    per_doc = lines.join(items, lines["item_id"].eqNullSafe(items["item_id"])).select(lines["doc_id"].alias("_id"), F.struct(lines["item_id"], "shift", "item").alias("c"))
    texts = _hashed(only(docs, "doc_id", "text"), "words").select("doc_id", "words")
    pairs = texts.join(per_doc, texts["doc_id"].eqNullSafe(per_doc["_id"])).select("doc_id", "words", "c.*")
    run = F.least(F.size("item"), F.lit(min_overlap))
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item"), F.size("words") - F.col("shift")) - 1
    equal = F.transform(F.sequence(first, last), lambda i: (F.get("words", i + F.col("shift")) == F.get("item", i)).cast("int"))
    sized = pairs.select("doc_id", "item_id", (first + F.col("shift")).alias("from"), run.alias("n_tokens"), F.when(last >= first, equal).otherwise(F.array().cast("array<int>")).alias("equal"))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("n_tokens") + 1), lambda i: F.struct(F.aggregate(F.slice("equal", i, F.col("n_tokens")), F.lit(0), lambda a, x: a + x).alias("n_equal"), (-i).alias("back")))
    best = sized.filter(F.size("equal") >= F.col("n_tokens")).select("doc_id", "item_id", "from", "n_tokens", F.array_max(sums).alias("b"))
    good = best.filter(F.col("b.n_equal") >= F.ceil(F.col("n_tokens") * (1 - max_substituted)))
    found = good.select("doc_id", "item_id", (F.col("from") - F.col("b.back") - 1).cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("b.n_equal").cast("long").alias("n_equal"))
    top = F.max_by(F.struct("start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(top.alias("t")).select("doc_id", "item_id", "t.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, with their columns as they are."""
    hit = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")
