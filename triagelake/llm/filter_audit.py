"""How filters interact: what each removes in every order, and its Shapley value, by counting paths in the subset lattice."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.common import only, write_stage

#: fixed values: the filters of the query, by letter
FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails A to D; E needs the other texts."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(3).cast("long") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail.

    Bit k of ``mask`` is the k-th filter. A null text is empty, a null lang the empty string. E fails where
    a smaller doc_id has the same text; a row without a doc_id is neither smaller nor larger, and rows that
    repeat a doc_id don't fail by each other. A document is good or toxic if any label row says so.
    Other columns aren't read. Only ids, digests and bits are shuffled. Texts are told apart by MD5;
    equal ones are counted before the shuffle by text, so a text of a third of the rows is a few counts.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(text).items()), F.lit(0))
    d = only(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.md5(text).alias("digest"), bits.cast("int").alias("mask"))
    d, _ = write_stage(d, "own-failures")  # texts are read once, however the labels are joined
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = only(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(said("quality"), said("toxic"))
    d = d.join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    key = ("digest", "mask", "part", "quality", "toxic")
    each = d.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("c"))
    # rows of the least doc_id of each kind of copy; of these only the ones of the text's least doc_id pass E
    kinds = each.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("no_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("low"))
    one = kinds.withColumn("least", F.min("low.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.c")).otherwise(0)
    rows = one.select("part", "quality", "toxic", F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n")))).alias("m")).select("part", "quality", "toxic", "m.*")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias({"quality": "good"}.get(c, c))
    return rows.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality"), of("toxic"))


def lattice(filters: str) -> list[dict]:
    """The edges of the subset lattice with the number of orders through each.

    Going up from the empty set, each state gets the number of orders that reach it; going down from
    the full set, the number of orders that leave it. An edge (before, bit) lies on their product.
    """
    size = 1 << len(filters)
    bits = [1 << k for k in range(len(filters))]
    reach, leave = [0] * size, [0] * size
    reach[0] = leave[-1] = 1
    for s in range(size):
        for b in bits:
            if not s & b:
                reach[s | b] += reach[s]
    for s in reversed(range(size)):
        for b in bits:
            if not s & b:
                leave[s] += leave[s | b]
    return [{"before": s, "bit": b, "orders": reach[s] * leave[s | b]} for s in range(size) for b in bits if not s & b]


def _edge_sums(counts: DataFrame, filters: str) -> DataFrame:
    """(part, before, bit, orders, ...): what an edge keeps, removes and finds removed."""
    edges = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.items()]) for e in lattice(filters)])
    # a part has at most 2 ** filters masks, so its counts are a bounded array
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("of")).select("part", "of", F.explode(edges).alias("e")).select("part", "of", "e.*")

    def total(column: str, when) -> Column:
        return F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["mask"]), x[column]).otherwise(0).cast("long"))

    before, bit = F.col("before"), F.col("bit")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    sums: Mapping[str, Column] = {
        "kept": total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0),
        "removed": total("n", here),
        "redundant": total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)),
        "unique_fails": total("n", lambda m: m == bit),
        "good_lost": total("good", here),
        "toxic_lost": total("toxic", here),
    }
    return parts.select("part", "before", "bit", "orders", *[c.alias(n) for n, c in sums.items()])


def order_steps(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, step, before, bit): the edge that each step of each order takes. filters! x filters rows."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(filters[j] for j in order), step, before, 1 << k))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def interaction_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counts`` is (part, mask, n, good, toxic). The sums of an edge are taken once and read by every order
    that passes it. ``shapley`` is what the step's filter removes, summed over all orders: its edges'
    removals weighted by the orders through them. No documents: no parts, no rows.
    """
    counts, _ = write_stage(counts, "failure-counts")  # read twice: by the steps and by the values
    edges = _edge_sums(counts, filters)
    shapley = edges.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = edges.join(F.broadcast(order_steps(counts.sparkSession, filters)), ["before", "bit"]).join(shapley, ["part", "bit"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
