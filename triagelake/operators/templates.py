"""Order-free template mining and frozen matching.

Mining works on distinct masked shapes, never on lines: lines collapse map-side by shape, variable
positions become wildcards by group-by, and the remaining shapes of one bucket are merged, those of a
large bucket over many tasks. The result does not depend on line order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, pin_small, running_totals
from triagelake.functions.text import SESSION_LOG_MASKS, WILDCARD, mask, strip

UNKNOWN_TEXT = "UNKNOWN"
#: a whole token that holds a digit, with the blank before it: looking behind every character takes ten times as long
DIGIT_TOKEN = r"(^|\s)[^\s\d]*+\d\S*+"
#: up to this many more positions than must agree, shapes are linked by pairs of tokens
PAIRED = 24
#: a bucket of more shapes than this is cut into parts that can't influence one another; same templates either way
MAX_SHAPES_PER_BUCKET = 2_000


#: stages of texts take less disk so
STAGE_CODEC = "zstd"
#: rows of templates sent back to Spark at once
ROWS_PER_BATCH = 5_000


def shape_text(content: Column, masks: Sequence[str] = SESSION_LOG_MASKS) -> Column:
    """Masked tokens joined by spaces; a token that still holds a digit is variable too."""
    return F.regexp_replace(F.regexp_replace(strip(mask(content, masks)), DIGIT_TOKEN, f"$1{WILDCARD}"), r"\s+", " ")


def shape_tokens(content: Column, masks: Sequence[str] = SESSION_LOG_MASKS) -> Column:
    """The tokens of ``shape_text``."""
    return F.array_remove(F.split(shape_text(content, masks), " "), "")  # only an empty text gives an empty token


def with_shape(lines: DataFrame, content: str = "content", masks: Sequence[str] = SESSION_LOG_MASKS) -> DataFrame:
    """Add ``shape``, the masked tokens joined by spaces, for a table that is mined and matched: masked once."""
    return lines.withColumn("shape", shape_text(F.col(content), masks))


class _Bucket:
    """The templates of one part of a bucket, one column each; 0 is the wildcard."""

    def __init__(self, tokens: list[str], size: int):
        self.codes = {WILDCARD: 0}
        self.merged = np.empty((len(tokens), 4), dtype=np.int32)
        self.totals: list[int] = []
        self._append(tokens, size)

    def _append(self, tokens: list[str], size: int) -> None:
        used = len(self.totals)
        if used == self.merged.shape[1]:
            self.merged = np.concatenate((self.merged, np.empty_like(self.merged)), axis=1)
        self.merged[:, used] = [self.codes.setdefault(t, len(self.codes)) for t in tokens]
        self.totals.append(size)

    def add(self, tokens: list[str], size: int, sim_th: float) -> None:
        """Merge a shape into the most similar template so far, the first of equals, or let it be one."""
        row = np.array([self.codes.get(t, -1) or -2 for t in tokens], dtype=np.int32)  # -1: in no template so far; -2: a wildcard agrees with nothing
        same = (self.merged[:, : len(self.totals)] == row[:, None]).view(np.uint8)
        same = same.sum(axis=0, dtype=np.uint8 if len(row) < 256 else np.int64)
        best = int(same.argmax())
        if same[best] / len(row) >= sim_th:
            old = self.merged[:, best]
            self.merged[:, best] = np.where(old == row, old, 0)
            self.totals[best] += size
        else:
            self._append(tokens, size)

    def templates(self) -> list[str]:
        names = list(self.codes)
        return [" ".join([names[c] for c in m]) for m in self.merged[:, : len(self.totals)].T.tolist()]


def _merge_sorted(sim_th: float):
    """Merge the shapes of each part of a bucket, biggest first, into the most similar template so far.

    The rows come sorted by part; only the templates of one part are held, never its shapes. The only shape of a
    part is its template.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, total, bucket, texts, sizes = None, "", 0, None, [], []

        def close() -> None:
            if bucket is not None:
                texts.extend(bucket.templates()), sizes.extend(bucket.totals)
            elif key is not None:
                texts.append(text), sizes.append(total)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["template", "size"])
            texts.clear(), sizes.clear()
            return out

        for b in batches:
            for *part, shape, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != key:
                    close()
                    key, text, total, bucket = part, shape, size, None
                    if len(texts) >= ROWS_PER_BATCH:
                        yield flush()
                else:
                    if bucket is None:
                        bucket = _Bucket(text.split(" "), total)
                    bucket.add(shape.split(" "), size, sim_th)
        close()
        if texts:
            yield flush()

    return merge


def mine_templates(
    lines: DataFrame,
    content: str = "content",
    masks: Sequence[str] = SESSION_LOG_MASKS,
    sim_th: float = 0.5,
    max_children: int | None = None,
    shape: str | None = None,
) -> DataFrame:
    """Templates (template_id, template, size) of the TRAIN contents.

    Shapes are bucketed by (token count, first token); each bucket is merged on its own, so the lines
    of one bucket never change the templates of another. The rule is the same at every size: the shapes
    pass one by one, biggest first, so a task holds templates only. A bucket of more than
    MAX_SHAPES_PER_BUCKET shapes is cut into parts whose shapes can't meet (``independent_parts``), each the
    work of one task, to the same templates. With ``max_children`` (a setting of the
    usual miners), positions of a bucket with more different tokens than that become wildcards first,
    and so does the first token of all but the most frequent such buckets of a length.

    ``shape`` names a column that ``with_shape`` made from ``content`` by the same masks.
    """
    # by text: counted without sorting, which arrays are not; empty ones go afterwards, or each line would be masked twice
    text = shape_text(F.col(content), masks) if shape is None else F.col(shape)
    counted = lines.filter(F.col(content).isNotNull()).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("size"))
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    shapes = counted.withColumn("len", (blanks + 1).cast("int")).withColumn("first", F.substring_index("text", " ", 1))
    shapes = materialize(shapes, "shapes", STAGE_CODEC).filter(F.col("text") != "").withColumn("tokens", F.split("text", " "))
    if max_children is not None:
        shapes = materialize(_limit_children(shapes, max_children), "shapes").withColumn("text", F.array_join("tokens", " "))
    by = ("len", "first", "part")
    parts = independent_parts(shapes, sim_th).select(*by, "text", "size")
    ordered = parts.repartition(*by).sortWithinPartitions(*by, F.desc("size"), "text")
    merged = ordered.mapInArrow(_merge_sorted(sim_th), "template string, size long")
    distinct = materialize(merged.groupBy("template").agg(F.sum("size").alias("size"), F.lit(1).alias("one")), "templates", STAGE_CODEC)
    return with_stable_ids(distinct)


def independent_parts(shapes: DataFrame, sim_th: float = 0.5) -> DataFrame:
    """Add ``part``: shapes of one bucket in different parts can't become one template.

    A shape joins a template only if it agrees with it at sim_th of the positions or more, and a template's tokens
    are those of all its members. So two shapes that agree at fewer positions never meet, and shapes linked
    by no chain of such pairs may be merged apart. Pairs aren't listed: ordered by how rare their
    tokens are in the bucket, two shapes that agree at h positions agree at one of the first w - h + 1
    of the w fixed ones, and at two of the first w - h + 2. All shapes that share two such (position, token)
    entries are linked; lines so long that the pairs would be many (PAIRED) by one. That links more than
    need be, never less. Buckets of up to MAX_SHAPES_PER_BUCKET shapes are one part.
    """
    by = ("len", "first")
    sizes = pin_small(shapes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MAX_SHAPES_PER_BUCKET).select(*by, F.lit(True).alias("_big")))
    if sizes.isEmpty():
        return shapes.withColumn("part", F.lit(0).cast("long"))
    marked = shapes.join(sizes, list(by), "left")
    big = materialize(marked.filter("_big").drop("_big").withColumn("id", F.xxhash64("tokens")), "large-buckets")
    # the first token is the same all over a bucket, so it counts for every pair
    need = F.ceil(F.col("len") * F.lit(sim_th)) - (F.col("first") != WILDCARD).cast("int")
    fixed = big.select(*by, "id", need.alias("need"), F.posexplode("tokens").alias("pos", "token")).filter((F.col("pos") > 0) & (F.col("token") != WILDCARD))
    rarity = fixed.groupBy(*by, "pos", "token").agg(F.count(F.lit(1)).alias("df"))
    entry = F.struct("df", "pos", "token")
    sets = fixed.join(rarity, [*by, "pos", "token"]).groupBy(*by, "id", "need").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    paired = (F.col("need") >= 2) & (F.col("len") - F.col("need") <= PAIRED)
    several = F.filter("s", lambda e: e["df"] > 1)  # what only one shape has links nothing
    spare = F.size("s") - F.col("need") + F.when(paired, 2).otherwise(1) - (F.size("s") - F.size(several))
    prefix = F.slice(several, F.lit(1), F.greatest(spare, F.lit(0)).cast("int"))
    code = F.transform(prefix, lambda e: F.xxhash64(*by, e["pos"], e["token"]))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    keys = sets.filter(F.col("need") > 0).select("id", paired.alias("two"), code.alias("p"))
    keys = keys.select("id", F.explode(F.when(F.col("two"), pairs).otherwise(F.col("p"))).alias("key"))
    # where the first token alone is enough, the whole bucket is linked
    whole = big.filter(need <= 0).select("id", F.xxhash64(*by).alias("key"))
    labels = linked(materialize(keys.unionByName(whole), "shape-keys"))
    parted = big.join(labels, "id", "left").withColumn("part", F.coalesce("label", "id")).drop("id", "label")
    return marked.filter(F.col("_big").isNull()).drop("_big").withColumn("part", F.lit(0).cast("long")).unionByName(parted)


def linked(members: DataFrame) -> DataFrame:
    """(id, label) of (id, key): ids with a common key, and those linked through others, have one label.

    Each round a key takes the least label of its ids, an id the least of its keys, and then the label of its
    label, so chains halve. Rounds are written tables; they end when no label changes.
    """
    labels = materialize(members.select("id").distinct().withColumn("label", F.col("id")), "labels")
    while True:
        low = members.join(labels, "id").groupBy("key").agg(F.min("label").alias("low"))
        least = members.join(low, "key").groupBy("id").agg(F.min("low").alias("low"))
        hop = labels.select(F.col("id").alias("low"), F.col("label").alias("_next"))
        now = labels.join(least, "id").join(hop, "low", "left")
        now = now.select("id", F.least("label", "low", F.coalesce("_next", "low")).alias("new"), "label")
        now = materialize(now, "labels")
        if now.filter(F.col("new") < F.col("label")).isEmpty():
            return now.select("id", F.col("new").alias("label"))
        labels = now.select("id", F.col("new").alias("label"))


def _limit_children(shapes: DataFrame, most: int) -> DataFrame:
    """Wildcards for the first tokens of a length beyond the ``most`` most frequent, and wide positions."""
    firsts = shapes.groupBy("len", "first").agg(F.sum("size").alias("s"))
    rank = F.row_number().over(Window.partitionBy("len").orderBy(F.desc("s"), "first"))
    kept = firsts.withColumn("r", rank).filter(F.col("r") <= most).select("len", "first", F.lit(True).alias("keep"))
    rest = F.concat(F.array(F.lit(WILDCARD)), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))))
    shapes = shapes.join(kept, ["len", "first"], "left").select(
        "len", F.when(F.col("keep"), F.col("first")).otherwise(F.lit(WILDCARD)).alias("first"), F.when(F.col("keep"), F.col("tokens")).otherwise(rest).alias("tokens"), "size"
    )
    spread = shapes.select("len", "first", F.posexplode("tokens").alias("p", "t")).distinct()
    wide = spread.groupBy("len", "first", "p").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > most)
    wide = wide.groupBy("len", "first").agg(F.collect_set("p").alias("wide"))
    masked = F.transform("tokens", lambda t, i: F.when(F.array_contains("wide", i), F.lit(WILDCARD)).otherwise(t))
    out = shapes.join(wide, ["len", "first"], "left").withColumn("tokens", F.when(F.col("wide").isNull(), F.col("tokens")).otherwise(masked))
    return out.groupBy("len", "first", "tokens").agg(F.sum("size").alias("size"))


def with_stable_ids(templates: DataFrame) -> DataFrame:
    """Ids by rank of the template text, so equal dictionaries have equal ids."""
    ranked = running_totals(templates, "template", {"template_id": "one"})
    return ranked.select(F.col("template_id").cast("int").alias("template_id"), "template", "size")


def match_templates(
    lines: DataFrame, templates: DataFrame, content: str = "content", masks: Sequence[str] = SESSION_LOG_MASKS, shape: str | None = None
) -> DataFrame:
    """Frozen match: a template fits if every token is equal or a wildcard in the template.

    Only the distinct shapes of the lines are matched; lines then join their shape. A stream, whose
    shapes can't be gathered, is matched line by line. The most specific template wins; a line without
    one gets id -1. ``shape`` names a column that ``with_shape`` made from ``content`` by the same masks.
    """
    if lines.isStreaming:
        return _match_rows(lines, templates, content, masks)
    text = shape_text(F.col(content), masks) if shape is None else F.col(shape)
    shapes = lines.select(text.alias("_shape")).filter(F.col("_shape").isNotNull()).distinct()
    matched = materialize(_match_rows(shapes, templates, "_shape", (), split=True), "matched-shapes")
    keyed = lines.withColumn("_shape", text).join(matched, "_shape", "left").drop("_shape")
    return keyed.withColumn("template_id", F.coalesce("template_id", F.lit(-1))).withColumn("template", F.coalesce("template", F.lit(UNKNOWN_TEXT)))


def _match_rows(lines: DataFrame, templates: DataFrame, content: str, masks: Sequence[str], split: bool = False) -> DataFrame:
    """Match row by row. Each row looks up one row per bucket that holds the bucket's templates.

    ``split``: the content is a shape already, its tokens joined by spaces.
    """
    toks = F.split("template", " ")
    entry = F.struct(
        F.size(F.filter(toks, lambda t: t == WILDCARD)).alias("wild"), F.col("template").alias("template"),
        F.col("template_id").alias("id"), toks.alias("toks"),
    )
    buckets = pin_small(
        templates.groupBy(F.size(toks).alias("_len"), F.get(toks, F.lit(0)).alias("_first")).agg(F.array_sort(F.collect_list(entry)).alias("_cands"))
    )
    wild = pin_small(buckets.filter(F.col("_first") == WILDCARD).select("_len", F.col("_cands").alias("_wild")))

    def fits(c: Column) -> Column:
        pairs = F.zip_with(c["toks"], F.col("_tok"), lambda a, b: (a == b) | (a == WILDCARD))
        return F.forall(pairs, lambda ok: ok)

    tok = F.split(content, " ") if split else shape_tokens(F.col(content), masks)
    keyed = lines.withColumn("_tok", tok).withColumn("_len", F.size("_tok")).withColumn("_first", F.get("_tok", F.lit(0)))
    found = keyed.join(buckets, ["_len", "_first"], "left").join(wild, "_len", "left")
    none = F.array().cast(buckets.schema["_cands"].dataType)
    either = F.array_sort(F.concat(F.coalesce("_cands", none), F.when(F.col("_first") != WILDCARD, F.coalesce("_wild", none)).otherwise(none)))
    hit = F.get(F.filter(either, fits), F.lit(0))
    return (
        found.withColumn("_hit", hit)
        .withColumn("template_id", F.coalesce(F.col("_hit.id"), F.lit(-1)))
        .withColumn("template", F.coalesce(F.col("_hit.template"), F.lit(UNKNOWN_TEXT)))
        .drop("_tok", "_len", "_first", "_cands", "_wild", "_hit")
    )


def template_catalog(parsed: DataFrame) -> DataFrame:
    """Templates in use with their number of records."""
    return parsed.filter(F.col("template_id") != -1).groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("size"))
