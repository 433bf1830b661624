"""Near-duplicates: consistent weighted samples of TF-IDF shingles, banded, then verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import give_back, mix, mix_into, only, prepared, shingle_hashes, texts, word_hashes, write_stage

SHINGLE = 5
SIMILARITY = 0.8
#: a pair at the threshold misses all bands with probability (1 - 0.8**4)**16 = 0.0002
BANDS, ROWS = 16, 4
#: text counted, asked about and signed at once
BLOCK_BYTES = 4 << 20
#: texts of one block are hashed and sorted in pieces that stay in the cache
PIECE = 1 << 18
#: times that leaders of a bucket are compared with its members before the rest is compared in pairs
ROUNDS = 3
#: shingles sampled at once
GROUP = 1 << 15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles at 2**16 levels, and their logs; found by bisection."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    q = (lo + hi) / 2
    return q, np.log(q)


def weights(times: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """(1 + ln times) (1 + ln(total / df)): a phrase said a hundred times doesn't outweigh the rest of a text."""
    return (1 + np.log(times)) * (1 + np.log(total / df))


def vectors(batch: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, times, number per text): the distinct shingles of each text, in order of hash."""
    h, n = shingle_hashes(*word_hashes(batch), k)
    text = np.repeat(np.arange(len(batch)), n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.bincount(text[at], minlength=len(batch))


def _vectors_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``vectors`` of a whole block, piece by piece."""
    out, a, size = [], 0, 0
    for i, t in enumerate(batch):
        size += len(t)
        if size >= PIECE or i + 1 == len(batch):
            out.append(vectors(batch[a : i + 1]))
            a, size = i + 1, 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct_texts(body: DataFrame) -> tuple[DataFrame, int]:
    """(key, doc_id, text, block, slices), one row per distinct text with its least doc_id, and their number; written.

    Copies collapse in each task before the shuffle, so a text that fills a third of the rows is sent
    once by each task. A block is a group of about BLOCK_BYTES of text, told by the key alone.
    """
    rows = body.select(text_key(F.col("text")).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found, _ = write_stage(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")), "distinct-texts", compression="zstd")
    total, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = 1 + (size or 0) // BLOCK_BYTES
    slices = 1 + blocks // 4
    return found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("slices", F.lit(slices)), total


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes first: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def document_frequencies(found: DataFrame) -> DataFrame:
    """(block, slice, df): in how many distinct texts each shingle of a block is found, in order of hash.

    Every shingle is counted over all texts. A block counts its own texts first and asks one slice of
    the range of hashes after the other: sorted hashes are sent as the steps between them, one row for a
    block and slice. A slice adds up the counts of all blocks and answers in the order asked, so an
    answer is a list of numbers. There are a quarter as many slices as blocks, so neither grows with the table,
    and a shingle in every text is one number for each block.
    """

    def ask(table: pa.Table) -> pa.Table:
        h, c = np.unique(_vectors_of(texts(table))[0], return_counts=True)
        block, slices = table.column("block")[0].as_py(), table.column("slices")[0].as_py()
        out = {"block": [], "slice": [], "h": [], "c": []}
        which = _slice(h, slices)
        for at in np.split(np.arange(len(h)), np.flatnonzero(np.diff(which)) + 1) if len(h) else []:
            out["block"].append(block), out["slice"].append(int(which[at[0]]))
            out["h"].append(_planes(np.diff(h[at], prepend=np.uint64(0)))), out["c"].append(_planes(c[at].astype(np.int32)))
        give_back()
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("h", pa.binary()), ("c", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        h = [np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in table.column("h").to_pylist()]
        c = np.concatenate([_numbers(x, np.int32) for x in table.column("c").to_pylist()])
        ends = np.cumsum([len(x) for x in h])[:-1]
        _, at = np.unique(np.concatenate(h), return_inverse=True)
        df = np.bincount(at, weights=c).astype(np.int64)[at]
        out = [_planes(x) for x in np.split(df, ends)]
        give_back()
        return pa.table([table.column("block"), table.column("slice"), pa.array(out, pa.binary())], names=["block", "slice", "df"])

    asked = found.select("block", "slices", "text").groupBy("block").applyInArrow(ask, "block long, slice long, h binary, c binary")
    return write_stage(asked.groupBy("slice").applyInArrow(answer, "block long, slice long, df binary"), "frequencies")[0]


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    """Which of the equal ranges of hashes each is in; at most 2**32 ranges."""
    return ((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def samples(h: np.ndarray, weight: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """``n`` improved consistent weighted samples of each text: (texts with shingles) x n hashes.

    For shingle and sample number: r, c from Gamma(2, 1), b uniform, all from one hash;
    t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b) - r is drawn, together
    with its t. Two texts draw the same with a probability equal to their weighted Jaccard similarity.
    """
    gamma, log_gamma = _tables()
    count = count[count > 0]
    out = np.empty((len(count), n), np.uint64)
    ends = np.cumsum(count)
    level = np.uint64(0xFFFF)
    a = 0
    while a < len(count):
        # so many texts that their shingles stay in the cache; every step writes over arrays that are there already
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP, side="right")))
        lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
        x, logs, starts = h[lo:hi], np.log(weight[lo:hi]), (ends[a:b] - count[a:b] - lo)
        own = np.repeat(np.arange(b - a), count[a:b])
        z, bits, t, rank, beta = (np.empty(hi - lo, kind) for kind in (np.uint64, np.uint64, float, float, float))
        for k in range(n):
            np.bitwise_xor(x, np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF), out=z)
            mix_into(z, bits)
            r = gamma.take(np.bitwise_and(z, level, out=bits).view(np.int64))
            np.multiply(np.right_shift(z, np.uint64(32), out=bits).view(np.int64), 2.0**-32, out=beta)
            np.floor(np.add(np.divide(logs, r, out=t), beta, out=t), out=t)
            np.bitwise_and(np.right_shift(z, np.uint64(16), out=bits), level, out=bits)
            log_gamma.take(bits.view(np.int64), out=rank, mode="clip")
            rank += np.multiply(np.subtract(np.subtract(beta, t, out=beta), 1, out=beta), r, out=beta)
            hits = np.flatnonzero(rank == np.minimum.reduceat(rank, starts)[own])
            first = hits[np.searchsorted(hits, starts)]
            out[a:b, k] = mix(x[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(drawn), bands), np.uint64)
    for b in range(bands):
        z = np.full(len(drawn), b + 1, np.uint64)
        for j in range(rows):
            z = mix(z * np.uint64(0x2545F4914F6CDD1D) + drawn[:, b * rows + j])
        out[:, b] = z
    return out


def similarities(left: list[str], right: list[str], df: list[bytes], total: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where either has no word.

    ``df`` holds the document frequencies of the shingles of each left, then each right text, in order of hash.
    """
    h, tf, n = vectors([*left, *right])
    w = weights(tf, np.frombuffer(b"".join(df), np.int64), total)
    ends = np.cumsum(n)
    part = lambda i: slice(ends[i] - n[i], ends[i])
    out = np.zeros(len(left))
    for i in range(len(left)):
        a, b = part(i), part(i + len(left))
        _, x, y = np.intersect1d(h[a], h[b], assume_unique=True, return_indices=True)
        both = np.minimum(w[a][x], w[b][y]).sum()
        whole = w[a].sum() + w[b].sum() - both
        out[i] = both / whole if whole > 0 else 0.0
    return out


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null is an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label): the least node that each node of (a, b) is linked to over any number of links.

    ``start`` holds the labels of earlier links; then only what the new links add is worked out. Each
    round moves every node to its least neighbour and contracts the links, which halves the nodes at
    least; rounds are written tables, and only the number of links left reaches the driver.
    """
    ends = links if start is None else _relabel(links, start, "a", "b")
    edges, _ = write_stage(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    moved = None
    while edges.count():
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        move, _ = write_stage(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "cc-moves")
        moved = move if moved is None else write_stage(_compose(moved, move), "cc-labels")[0]
        ends = _relabel(edges, move, "a", "b")
        edges, _ = write_stage(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    if start is None:
        return moved if moved is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if moved is None:
        return start
    fresh = moved.join(start.select("node"), "node", "left_anti")
    return write_stage(_compose(start, moved).unionByName(fresh), "cc-labels")[0]


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, label): where ``then`` takes the label that ``first`` gives."""
    step = then.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return first.join(step, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))


def _relabel(df: DataFrame, label: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the nodes in ``columns`` replaced by their labels, if they have one."""
    for c in columns:
        df = df.join(label.select(F.col("node").alias(c), F.col("label").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


@dataclass
class _Search:
    """What the rounds of one search share."""

    texts: DataFrame  # key, text, df: texts that share a bucket with another
    total: int
    least: float

    def unshared(self, keys: DataFrame) -> DataFrame:
        """(key, u): weight of the shingles of a text that no other of the keyed texts has."""
        total = self.total

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, tf, n = vectors(texts(b))
                ids = np.repeat(b.column("id").to_numpy(), n)
                w = weights(tf, np.frombuffer(b"".join(b.column("df").to_pylist()), np.int64), total)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(w)], ["h", "id", "w"])
            give_back()

        rows = self.texts.join(keys, "key").select(F.xxhash64("key").alias("id"), "text", "df").mapInArrow(weigh, "h long, id long, w double")
        single = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("w").alias("w")).filter("n = 1")
        u, _ = write_stage(single.groupBy("id").agg(F.sum("w").alias("u")), "unshared")
        return keys.withColumn("id", F.xxhash64("key")).join(u, "id").select("key", "u")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of pairs of keys, compared as whole texts; written."""
        total = self.total

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    df = [*b.column("left_df").to_pylist(), *b.column("right_df").to_pylist()]
                    s = similarities(texts(b, "left"), texts(b, "right"), df, total)
                    yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s)], ["a", "b", "similarity"])
            give_back()

        left, right = (self.texts.select(F.col("key").alias(k), F.col("text").alias(side), F.col("df").alias(f"{side}_df")) for k, side in (("a", "left"), ("b", "right")))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right", "left_df", "right_df")
        return write_stage(rows.mapInArrow(compare, "a binary, b binary, similarity double"), "compared")[0]


def _possible(xw: Column, xu: Column, yw: Column, yu: Column, similarity: float) -> Column:
    """Whether two weights, less what each shares with no other text, can be that similar at all."""
    return F.least(xw - xu, yw - yu) >= similarity * F.greatest(xw + yu, yw + xu) - 1e-9


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows of buckets whose members are of more than one component."""
    several = labelled.groupBy("band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("band")
    return labelled.join(several, "band")


def _links_of(compared: DataFrame, least: float) -> DataFrame:
    return compared.filter(F.col("similarity") >= least - 1e-12).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, key, class_id: one row per row of ``docs``; a class is what links connect.

    Texts are linked if their weighted Jaccard similarity over TF-IDF shingles of five words is at
    least ``similarity`` and they share a band of samples. The inverse document frequency of a shingle
    is 1 + ln(N / df) over the N distinct texts, counted exactly for every shingle. Equal texts are one node, so copies cost
    nothing. In each bucket of a band the member that meets most others leads: all members are
    compared with it, and those it is linked to are one component from then on. In the next rounds
    about 2 log2(n) of the n members outside its component lead, and each is compared with all that
    are not of its own component. After ``rounds`` rounds, members that never led and are still in
    different components are compared in pairs, less those that sizes or the distances to the first
    leader rule out (one less the similarity is a metric). After the first round, pairs are also left
    out where the weight that a text shares with no other open text proves them too different. So no
    link between members of a bucket is lost, and n near copies cost about n log n comparisons.

    ``class_id`` is the least doc_id of the class, null if it has none. A text without words has no
    links; equal ones (null counts as empty) are one class. ``key`` stands for the text.
    """
    spark = prepared(docs.sparkSession)
    body = only(docs, "doc_id", "text")
    found, total = distinct_texts(body)
    frequencies = document_frequencies(found)

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        h, tf, n = _vectors_of(texts(left))
        answers = right.column("df")
        of = np.concatenate([np.zeros(0, np.int64), *[_numbers(answers[int(i)].as_py(), np.int64) for i in np.argsort(right.column("slice").to_numpy())]])
        df = of[np.unique(h, return_inverse=True)[1]]
        w = weights(tf, df, total)
        whole = np.bincount(np.repeat(np.arange(left.num_rows), n), weights=w, minlength=left.num_rows)
        del of, tf
        keys = band_keys(samples(h, w, n, bands * rows), bands, rows).view(np.int64)
        offsets = np.concatenate(([0], np.cumsum((n > 0) * bands))).astype(np.int32)
        ends = np.cumsum(n)
        own = [df[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
        give_back()
        return pa.table([left.column("key"), left.column("doc_id"), pa.array(whole, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel(), pa.int64())), pa.array(own, pa.binary())], names=["key", "doc_id", "w", "bands", "df"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = found.groupBy("block").cogroup(frequencies.groupBy("block"))
    nodes, _ = write_stage(both.applyInArrow(sign, f"key binary, doc_id {kind}, w double, bands array<long>, df binary"), "nodes")
    # buckets of two or more texts; a text that meets many others leads them
    spread, _ = write_stage(nodes.select("key", "w", F.explode("bands").alias("band")), "spread")
    sizes, _ = write_stage(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    inside, _ = write_stage(spread.join(sizes, "band"), "inside")
    meets, _ = write_stage(inside.groupBy("key").agg(F.sum("n").alias("meets")), "meets")
    members, _ = write_stage(inside.drop("n").join(meets, "key"), "members")
    candidates = nodes.select("key", "df").join(meets.select("key"), "key").join(found.select("key", "text"), "key")
    search = _Search(write_stage(candidates, "candidates")[0], total, similarity)

    # first round: the member that meets most others leads, and all are compared with it
    lead = members.groupBy("band").agg(F.max_by(F.struct("key", "w"), F.struct("meets", "key")).alias("l")).select("band", "l.*")
    first, _ = write_stage(lead.toDF("band", "leader", "lw"), "leaders")
    fits = F.least("w", "lw") >= similarity * F.greatest("w", "lw") - 1e-9
    pairs = members.join(first, "band").filter((F.col("key") != F.col("leader")) & fits)
    led_by = search.verify(pairs.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct())
    label = components(_links_of(led_by, similarity))
    # what still has to be looked at, with the weight that no other such text shares
    open_, _ = write_stage(_mixed(_labelled(members.drop("meets"), label)).drop("label"), "open")
    alone = search.unshared(open_.select("key").distinct())
    open_, _ = write_stage(open_.join(alone, "key", "left").withColumn("u", F.coalesce("u", F.lit(0.0))), "open")
    led = [first.select("band", "leader")]
    possible = lambda x, y: _possible(*(F.col(f"{p}_{c}") for p in (x, y) for c in ("w", "u")), similarity)
    for i in range(1, rounds):
        now = _labelled(open_, label)
        free = _free(now, led[0], led, label)
        n = free.groupBy("band").agg(F.count(F.lit(1)).cast("double").alias("n"))
        share = (2 * F.log2("n") + 2) / F.col("n")
        draw = F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1 << 20)) / F.lit(1 << 20)
        lead, _ = write_stage(free.join(n, "band").filter(draw < share).select("band", *[F.col(c).alias(f"l_{c}") for c in ("key", "label", "w", "u")]), "leaders")
        both = now.select("band", *[F.col(c).alias(f"m_{c}") for c in ("key", "label", "w", "u")]).join(lead, "band").filter((F.col("m_label") != F.col("l_label")) & possible("m", "l"))
        seen = search.verify(both.select(F.least("m_key", "l_key").alias("a"), F.greatest("m_key", "l_key").alias("b")).distinct())
        led.append(lead.select("band", F.col("l_key").alias("leader")))
        label = components(_links_of(seen, similarity), label)
    # the rest in pairs: members of different components, none of them a leader of the bucket; a pair
    # is looked at in the first bucket that it shares
    rest = _free(_labelled(open_, label), None, led, label).join(first.drop("lw"), "band")
    far = led_by.union(led_by.select("b", "a", "similarity")).toDF("key", "leader", "s")
    rest = _mixed(rest.join(far, ["key", "leader"], "left").select("band", "key", "label", "w", "u", "s"))
    of = rest.groupBy("key").agg(F.collect_set("band").alias("of"))  # at most one for each band
    rest, _ = write_stage(rest.join(of, "key").select("band", "key", "label", "w", "u", "s", "of"), "rest")
    x, y = (rest.toDF("band", *[f"{p}_{c}" for c in ("key", "label", "w", "u", "s", "of")]) for p in "xy")
    near = F.coalesce(F.abs(F.col("x_s") - F.col("y_s")) <= 1 - similarity + 1e-9, F.lit(True))
    pairs = x.join(y, "band").filter((F.col("x_key") < F.col("y_key")) & (F.col("x_label") != F.col("y_label")) & possible("x", "y") & near & (F.array_min(F.array_intersect("x_of", "y_of")) == F.col("band")))
    label = components(_links_of(search.verify(pairs.select(F.col("x_key").alias("a"), F.col("y_key").alias("b"))), similarity), label)
    classes, _ = write_stage(_labelled(nodes.select("key", "doc_id"), label), "classes")
    ids = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of, _ = write_stage(classes.join(ids, "label").select("key", "class_id"), "class-ids")
    return body.select("doc_id", text_key(F.col("text")).alias("key")).join(of, "key").select("doc_id", "key", "class_id")


def _free(now: DataFrame, first: DataFrame | None, led: list[DataFrame], label: DataFrame) -> DataFrame:
    """Members that never led their bucket, in other components than its first leader."""
    if first is not None:
        of = _labelled(first.toDF("band", "key"), label).select("band", F.col("label").alias("_of"))
        now = now.join(of, "band").filter("label <> _of").drop("_of")
    return now.join(reduce(DataFrame.union, led).toDF("band", "key"), ["band", "key"], "left_anti")


def _labelled(df: DataFrame, label: DataFrame | None) -> DataFrame:
    """Add the component of ``key``; a key without links is its own."""
    if label is None:
        return df.withColumn("label", F.col("key"))
    return df.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with its columns as they are: that of the least doc_id (null last)."""
    classes, _ = write_stage(near_duplicates(docs, **options), "near-duplicates")
    # of equal doc_ids the least key; a class of null ids alone has a null class_id, so its keys decide
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    winner = classes.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("key")).alias("_alone")).agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.key").alias("_key"))
    # the input travels as one struct, so no name of its columns meets one of the operator's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", text_key(F.col("row.text")))
    kept = keyed.join(winner, (F.col("key") == F.col("_key")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_id", "_key"]).select("row.*")
