"""Exact nearest neighbours without comparing all pairs: pivot cells and the triangle inequality.

Unit vectors lie on a sphere, where sqrt(2 - 2 cos) is a distance. Every corpus vector belongs to the
cell of its nearest pivot. A first round compares a query with the cells nearest to it until enough
members were seen; the distance of its k-th best then rules out every cell, and every ring of a
cell, that the triangle inequality keeps farther away. What is left is compared in a second round.
No vector is lost: the bounds are exact and every comparison is made on whole vectors.

Cells travel in groups of many, so a query is sent once to a group, not once to each of its cells, and
comes back with the best of the group. Where no cell can be ruled out, as among random vectors, a
row is copied as often as its dataset has groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize

#: rows of one side that one task compares
BLOCK_ROWS = 4_000
#: members of the cells that one task compares, and queries that it compares them with
GROUP_ROWS = 16_000
#: pivots of a dataset: the root of its rows, at most this many
MAX_PIVOTS = 4_096
#: similarities are rounded to this many places; only parallel vectors reach 1
PLACES = 6
BELOW_ONE = 1.0 - 10**-PLACES
#: added to every bound: the rounding of similarities and of distances near 0
SLACK = 1e-5
#: queries that one matrix product covers
PART = 128


def weights_matrix(tokens: pd.Series, weights: pd.Series, vocabulary: pd.Index) -> np.ndarray:
    """Rows of token weights as a matrix over ``vocabulary``; other tokens are left out."""
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    out = np.zeros((len(size), len(vocabulary)))
    if size.sum():
        at = vocabulary.get_indexer(np.concatenate(tokens.to_numpy()))
        row, value = np.repeat(np.arange(len(size)), size), np.concatenate(weights.to_numpy())
        out[row[at >= 0], at[at >= 0]] = value[at >= 0]
    return out


def unit_rows(weights: pd.Series) -> np.ndarray:
    m = np.stack(weights.to_numpy()).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def frame(parts: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    """Columns from the arrays of several parts; without any, empty columns that take any type."""
    return pd.DataFrame({k: np.concatenate(v) if v else np.array([], dtype=object) for k, v in parts.items()})


def cosines(a: pd.DataFrame, b: pd.DataFrame, sparse: bool) -> np.ndarray:
    """Similarities of the rows of ``a`` and ``b``: columns tok and w, or w alone where dense."""
    if not sparse:
        return unit_rows(a["w"]) @ unit_rows(b["w"]).T
    vocabulary = pd.Index(np.unique(np.concatenate([*a["tok"].to_numpy(), np.array([], dtype=object)])))
    return weights_matrix(a["tok"], a["w"], vocabulary) @ weights_matrix(b["tok"], b["w"], vocabulary).T


def _distances(a: pd.DataFrame, b: pd.DataFrame, sparse: bool) -> np.ndarray:
    """sqrt(2 - 2 cos). A vector without length is as if orthogonal to all but its like."""
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.clip(cosines(a, b, sparse), -1.0, 1.0)))
    both = ~a["held"].to_numpy(bool)[:, None] & ~b["held"].to_numpy(bool)[None, :]
    return np.where(both, 0.0, d)


def vectors(df: DataFrame, sparse: bool) -> DataFrame:
    """``vec`` as plain arrays (tok, w), and whether it has a length."""
    if sparse:
        return df.withColumn("tok", F.col("vec.token")).withColumn("w", F.col("vec.weight")).withColumn("held", F.exists("vec", lambda e: e["weight"] != 0)).drop("vec")
    # floats stay floats on the way; the kernels compute in doubles
    vec = F.col("vec") if df.schema["vec"].dataType.simpleString() == "array<float>" else F.col("vec").cast("array<double>")
    return df.withColumn("w", vec).withColumn("held", F.exists("w", lambda x: x != 0)).drop("vec")


def _in_blocks(rows: DataFrame, key: str, beside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows cut into blocks of their dataset, and ``beside`` copied to every block of its dataset."""
    blocks = rows.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    mine = rows.join(blocks, "dataset").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")
    copies = beside.join(blocks, "dataset").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return mine, copies


def choose_pivots(corpus: DataFrame) -> DataFrame:
    """About the root of each dataset's rows, those of least key hash: any choice gives the same neighbours."""
    sizes = corpus.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.xxhash64("ckey"), "ckey"))
    return corpus.withColumn("_r", rank).filter(F.col("_r") <= MAX_PIVOTS).join(sizes, "dataset").filter(F.col("_r") <= F.ceil(F.sqrt("n"))).drop("_r", "n", "first_chunk").withColumnRenamed("ckey", "cell")


def assign_cells(corpus: DataFrame, pivots: DataFrame, sparse: bool) -> DataFrame:
    """The corpus with its ``cell`` (nearest pivot) and the distance ``r`` from it."""

    def nearest(rows: pd.DataFrame, piv: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return frame({k: [] for k in (*names_out, "cell", "r")})
        cell, r = np.empty(len(rows), dtype=object), np.zeros(len(rows))
        piv = piv.sort_values("cell")
        names = piv["cell"].to_numpy()
        for lo in range(0, len(rows), PART):
            d = _distances(rows.iloc[lo : lo + PART], piv, sparse)
            best = d.argmin(axis=1)
            cell[lo : lo + PART], r[lo : lo + PART] = names[best], d[np.arange(len(d)), best]
        kept = {f: rows[f].to_numpy() for f in names_out}
        return pd.DataFrame(kept | {"cell": cell, "r": r})

    names_out = corpus.columns
    rows, piv = _in_blocks(corpus, "ckey", pivots)
    schema = f"{_types(corpus)}, cell string, r double"
    return rows.groupBy("dataset", "block").cogroup(piv.groupBy("dataset", "block")).applyInPandas(nearest, schema)


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def group_cells(members: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, cells) with the cell's number ``at`` and its ``group``, about GROUP_ROWS members of a dataset.

    A cell of more members than a group holds is cut into pieces, which count as cells of the same pivot.
    """
    sizes = members.groupBy("dataset", "cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("pieces"))
    cut = materialize(members.join(sizes, ["dataset", "cell"]).withColumn("piece", F.pmod(F.xxhash64("ckey"), F.col("pieces"))).drop("pieces"), "members")
    cells = cut.groupBy("dataset", "cell", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    order = Window.partitionBy("dataset").orderBy("cell", "piece")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.select("*", F.row_number().over(order).alias("at"), F.floor((upto - 1) / GROUP_ROWS).alias("group"))
    cells = materialize(cells.join(pivots, ["dataset", "cell"]), "cells")
    return cut.join(cells.select("dataset", "cell", "piece", "at", "group"), ["dataset", "cell", "piece"]).drop("piece"), cells


def plan_visits(queries: DataFrame, cells: DataFrame, keep: int, sparse: bool) -> DataFrame:
    """The queries, once for each group whose cells can hold one of the ``keep`` nearest.

    ``reach`` is a distance within which there certainly are ``keep`` members, ``least`` that of the nearest
    member the group may have, ``near`` its cell of the nearest pivot. The nearest cells that together
    hold ``keep`` members have their pivots within ``edge``; ``first`` marks groups that have one of them.
    """
    own = queries.columns

    def plan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in (*own, "group", "near", "edge", "reach", "least", "first")}
        if len(c):
            c = c.sort_values("at")
            group, number, n, lo, hi = (c[k].to_numpy() for k in ("group", "at", "n", "lo", "hi"))
            names, starts = np.unique(group, return_index=True)
            for at in range(0, len(q), PART):
                part = q.iloc[at : at + PART]
                d = _distances(part, c, sparse)
                row = np.arange(len(d))
                least = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                most = d + hi
                order = np.argsort(most, axis=1, kind="stable")
                enough = (np.cumsum(n[order], axis=1) >= keep).argmax(axis=1)
                reach = np.where(n.sum() >= keep, most[row, order[row, enough]], np.inf)
                nearest = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(n[nearest], axis=1) - n[nearest]
                first = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(first, nearest, before < keep, axis=1)
                edge = np.where(first, d, 0.0).max(axis=1)
                visited = (least <= reach[:, None] + SLACK) | first
                i, j = np.nonzero(np.logical_or.reduceat(visited, starts, axis=1))
                closest = np.stack([number[a + d[:, a:b].argmin(axis=1)] for a, b in zip(starts, [*starts[1:], len(group)], strict=True)], axis=1)
                may = np.minimum.reduceat(np.where(visited, least, np.inf), starts, axis=1)
                starting = np.logical_or.reduceat(first, starts, axis=1)
                for k, v in zip(list(out)[len(own) :], (names[j], closest[i, j], edge[i], reach[i], may[i, j], starting[i, j]), strict=True):
                    out[k].append(v)
                for k in own:
                    out[k].append(part[k].to_numpy()[i])
        return frame(out)

    rows, copies = _in_blocks(queries, "qkey", cells)
    schema = f"{_types(queries)}, `group` long, near int, edge double, reach double, least double, first boolean"
    return rows.groupBy("dataset", "block").cogroup(copies.groupBy("dataset", "block")).applyInPandas(plan, schema)


def best_of_part(part: pd.DataFrame, members: pd.DataFrame, rank: np.ndarray, keep: int, sparse: bool, keyed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Member positions and similarities of the ``keep`` best per query, ties by ``rank``."""
    sims = np.clip(np.round(cosines(part, members, sparse), PLACES), -1.0, 1.0)
    if keyed:  # keys name directions: equal keys are parallel; an empty vector is like nothing, not even another empty one
        same = part["qkey"].to_numpy()[:, None] == members["ckey"].to_numpy()[None, :]
        sims = np.where(same & part["held"].to_numpy(bool)[:, None], 1.0, np.minimum(sims, BELOW_ONE))
    order = -np.rint(sims * 10**PLACES).astype(np.int64) * (len(rank) + 1) + rank[None, :]
    k = min(keep, len(rank))
    best = np.argpartition(order, k - 1, axis=1)[:, :k]
    return best, np.take_along_axis(sims, best, axis=1)


class _Best:
    """The ``keep`` best members of each query of one part; members are offered position by position."""

    def __init__(self, part: pd.DataFrame, members: pd.DataFrame, rank: np.ndarray, unit: np.ndarray | None, keep: int, keyed: bool):
        self.part, self.members, self.rank, self.unit, self.keep, self.keyed = part, members, rank, unit, keep, keyed
        self.own = None if unit is None else unit_rows(part["w"])
        self.row, self.at, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(part), -np.inf)
        self.compared = np.zeros(len(part), np.int64)

    def offer(self, rows: np.ndarray, at: np.ndarray) -> None:
        self.compared[rows] += len(at)
        for lo in range(0, len(at), BLOCK_ROWS):
            self._offer(rows, at[lo : lo + BLOCK_ROWS])

    def _offer(self, rows: np.ndarray, at: np.ndarray) -> None:
        q = self.part.iloc[rows]
        raw = cosines(q, self.members.iloc[at], True) if self.unit is None else self.own[rows] @ self.unit[at].T
        bar = self.bar[rows]
        if len(at) > self.keep and np.isneginf(bar).any():
            bar = np.maximum(bar, np.partition(raw, -self.keep, axis=1)[:, -self.keep])
        # rounding and the limit below 1 move a similarity by less than this
        hit = raw >= np.minimum(bar, 1.0)[:, None] - 4.0 * 10**-PLACES
        i, j = np.nonzero(hit)
        sims = np.clip(np.round(raw[i, j], PLACES), -1.0, 1.0)
        if self.keyed:  # keys name directions: equal keys are parallel; an empty vector is like nothing, not even another empty one
            same = (q["qkey"].to_numpy()[i] == self.members["ckey"].to_numpy()[at[j]]) & q["held"].to_numpy(bool)[i]
            sims = np.where(same, 1.0, np.minimum(sims, BELOW_ONE))
        row, at, sims = (np.concatenate(x) for x in ((self.row, rows[i]), (self.at, at[j]), (self.sim, sims)))
        order = np.lexsort((self.rank[at], -sims, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        best = order[place < self.keep]
        last = order[place == self.keep - 1]
        self.bar[row[place == self.keep - 1]] = sims[last]
        self.row, self.at, self.sim = row[place < self.keep], at[best], sims[best]


FOUND = "dataset string, qkey string, ckey string, first_chunk string, sim double, compared long"


def compare_visits(visits: DataFrame, members: DataFrame, cells: DataFrame, keep: int, sparse: bool, keyed: bool) -> DataFrame:
    """(dataset, qkey, ckey, first_chunk, sim, compared): each task's ``keep`` best per query.

    ``visits`` has the queries with (group, near, edge, reach): of the group they are compared with the cells whose pivot
    is within ``edge``, and there with the members that ``reach`` doesn't rule out. More than GROUP_ROWS
    visitors of a group are cut into blocks. ``compared`` sums to the number of vector pairs that were compared.
    """

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("dataset", "qkey", "ckey", "first_chunk", "sim", "compared")}
        piv, c = c[c["n"].notna()].sort_values("at"), c[c["n"].isna()]  # only cells have a size
        if len(q) and len(c):
            c = c.sort_values(["at", "r", "ckey"]).reset_index(drop=True)
            q = q.sort_values(["near", "qkey"]).reset_index(drop=True)
            rank = np.empty(len(c), dtype=np.int64)
            rank[np.argsort(c["first_chunk"].to_numpy(), kind="stable")] = np.arange(len(c))
            r, keys, chunks = c["r"].to_numpy(), c["ckey"].to_numpy(), c["first_chunk"].to_numpy()
            begin, end = (np.searchsorted(c["at"].to_numpy(), piv["at"].to_numpy(), side) for side in ("left", "right"))
            inner, outer = r[begin], r[end - 1]
            unit = None if sparse else unit_rows(c["w"])
            for at in range(0, len(q), PART):
                part = q.iloc[at : at + PART]
                edge, reach = part["edge"].to_numpy()[:, None], part["reach"].to_numpy()[:, None]
                d = _distances(part, piv, sparse)
                visited = (d <= edge + SLACK) & (np.maximum(np.maximum(d - outer, inner - d), 0.0) <= reach + SLACK)
                low, high = np.where(visited, d - reach, np.inf).min(axis=0) - SLACK, np.where(visited, d + reach, -np.inf).max(axis=0) + SLACK
                ring = lambda k: np.arange(begin[k] + np.searchsorted(r[begin[k] : end[k]], low[k], "left"), begin[k] + np.searchsorted(r[begin[k] : end[k]], high[k], "right"))  # noqa: E731, B023
                best = _Best(part, c, rank, unit, keep, keyed)
                # cells that most of the part visit are compared at once, the others by their visitors alone
                share = visited.mean(axis=0)
                common = np.flatnonzero(share >= 0.5)
                if len(common):
                    best.offer(np.arange(len(part)), np.concatenate([ring(k) for k in common]))
                for k in np.flatnonzero((share > 0) & (share < 0.5)):
                    best.offer(np.flatnonzero(visited[:, k]), ring(k))
                out["dataset"].append(part["dataset"].to_numpy()[best.row])
                out["qkey"].append(part["qkey"].to_numpy()[best.row])
                out["ckey"].append(keys[best.at])
                out["first_chunk"].append(chunks[best.at])
                out["sim"].append(best.sim)
                once = np.diff(best.row, prepend=-1) > 0
                out["compared"].append(np.where(once, best.compared[best.row], 0))
        return frame(out)

    blocks = visits.groupBy("dataset", "group").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("blocks"))
    q = visits.join(blocks, ["dataset", "group"]).withColumn("block", F.pmod(F.xxhash64("qkey"), F.col("blocks"))).drop("blocks")
    c = members.unionByName(cells.drop("cell", "piece", "lo", "hi"), allowMissingColumns=True).join(blocks, ["dataset", "group"])
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "cell")
    by = ("dataset", "group", "block")
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(run, FOUND)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("dataset", "qkey").orderBy(F.desc("sim"), "first_chunk", "ckey"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= keep)


def cell_top_k(queries: DataFrame, corpus: DataFrame, keep: int, sparse: bool = True) -> DataFrame:
    """(dataset, qkey, ckey, sim, compared): the ``keep`` most similar corpus keys of each query's dataset.

    ``queries`` is (dataset, qkey, vec), ``corpus`` (dataset, ckey, first_chunk, vec), keys without
    repeats; sparse vectors are ordered (token, weight) arrays of unit length whose key names the
    direction. Similarities are cosines at 6 places, ties go to the least ``first_chunk``. A vector without
    length has similarity 0 to all: such a query gets the first chunks of its dataset. ``compared`` is
    the number of vectors the query was compared with, on each of its rows. A dataset with fewer than
    ``keep`` keys gives all of them, one without any gives no rows.
    """
    q = materialize(vectors(queries.select("dataset", "qkey", "vec"), sparse), "query-vectors")
    c = vectors(corpus.select("dataset", "ckey", "first_chunk", "vec"), sparse)
    pivots = materialize(choose_pivots(c), "pivots")
    members, cells = group_cells(materialize(assign_cells(c, pivots, sparse), "assigned"), pivots)
    visits = materialize(plan_visits(q.filter("held"), cells, keep, sparse), "visits")
    near = compare_visits(visits.filter("first").withColumn("reach", F.lit(float("inf"))), members, cells, keep, sparse, sparse)
    # what the first round finds only bounds the second, which finds it again
    by = Window.partitionBy("dataset", "qkey")
    kth = materialize(near, "first-round").select("dataset", "qkey", "sim", F.sum("compared").over(by).alias("compared"), F.row_number().over(by.orderBy(F.desc("sim"))).alias("_r"))
    kth = materialize(kth.filter(F.col("_r") == keep).select("dataset", "qkey", "compared", F.sqrt(F.lit(2.0) - 2.0 * F.col("sim") + 4.0 * 10**-PLACES).alias("_kth")), "reach")
    rest = visits.join(kth.drop("compared"), ["dataset", "qkey"], "left").withColumn("reach", F.least("reach", "_kth")).drop("_kth")
    rest = materialize(rest.filter(F.col("least") <= F.col("reach") + SLACK).withColumn("edge", F.lit(float("inf"))), "second-visits")
    far = compare_visits(rest, members, cells, keep, sparse, sparse)
    none = F.lit(None).cast("string")
    both = far.unionByName(kth.select("dataset", "qkey", none.alias("ckey"), none.alias("first_chunk"), F.lit(None).cast("double").alias("sim"), "compared"))
    best = _ranked(both.withColumn("compared", F.sum("compared").over(by)), keep).filter(F.col("sim").isNotNull()).select("dataset", "qkey", "ckey", "sim", "compared")
    ends = members.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy("first_chunk", "ckey"))).filter(F.col("_r") <= keep)
    empty = q.filter(~F.col("held")).select("dataset", "qkey").join(ends.select("dataset", "ckey"), "dataset")
    return best.unionByName(empty.select("dataset", "qkey", "ckey", F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("compared")))
