"""Pivot cells give the neighbours that comparing all pairs gives, with fewer comparisons."""

import numpy as np
import pytest

from triagelake.operators import cells, retrieval


def brute(queries, corpus, keep, keyed):
    out = {}
    for d, q, v in queries:
        rows = []
        for cd, c, chunk, u in corpus:
            if cd != d:
                continue
            a, b = np.array(v, float), np.array(u, float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            sim = float(np.clip(np.round(a @ b / n, cells.PLACES), -1, 1)) if n > 0 else 0.0
            if keyed:
                sim = 1.0 if q == c and n > 0 else min(sim, cells.BELOW_ONE)
            rows.append((-sim, chunk, c))
        out[d, q] = [(c, -s) for s, _, c in sorted(rows)[:keep]]
    return {k: v for k, v in out.items() if v}


def clustered(rng, n, dims, spread, centres=20):
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    x[rng.random(n) < 0.02] = 0.0
    x[rng.random(n) < 0.1] = x[0]
    return x


def found(df):
    out = {}
    for r in df.orderBy("dataset", "qkey").collect():
        out.setdefault((r["dataset"], r["qkey"]), []).append((r["ckey"], r["sim"]))
    return out


@pytest.mark.parametrize("block_rows", [7, 4_000])
def test_dense_neighbours_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cells, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    x, y = clustered(rng, 400, 6, 0.2), clustered(rng, 60, 6, 0.2)
    corpus = [("a" if i % 3 else "b", f"c{i}", f"{(i * 7) % 400:04d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("few", "f0", "f0", [1.0] * 6), ("few", "f1", "f1", [0.0] * 6)]
    queries = [("a" if i % 2 else "b", f"q{i}", [float(v) for v in r]) for i, r in enumerate(y)] + [("few", "q", [2.0] * 6), ("none", "q", [1.0] * 6), ("a", "zero", [0.0] * 6)]
    q = spark.createDataFrame(queries, "dataset string, qkey string, vec array<double>")
    c = spark.createDataFrame(corpus, "dataset string, ckey string, first_chunk string, vec array<double>")
    got, want = found(cells.cell_top_k(q, c, 4, sparse=False)), brute(queries, corpus, 4, False)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def _sparse(x):
    n = np.linalg.norm(x)
    return [(f"t{j}", float(round(v / n, 9))) for j, v in enumerate(x) if v] if n else []


def test_sparse_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    x = np.unique(rng.poisson(0.7, size=(500, 8)), axis=0).astype(float)
    key = lambda r: ",".join(map(str, r.astype(int)))
    corpus = [("a", key(r), f"{(i * 13) % 997:04d}", r) for i, r in enumerate(x)]
    queries = [("a", key(r), r) for r in np.unique(np.concatenate((x[::9], rng.poisson(1.0, size=(30, 8)), np.zeros((1, 8)))), axis=0)]
    schema = "vec array<struct<token:string,weight:double>>"
    q = spark.createDataFrame([(d, k, _sparse(r)) for d, k, r in queries], f"dataset string, qkey string, {schema}")
    c = spark.createDataFrame([(d, k, f, _sparse(r)) for d, k, f, r in corpus], f"dataset string, ckey string, first_chunk string, {schema}")
    got = found(cells.cell_top_k(q, c, 5))
    # vectors of one direction have one key in the library; here parallel ones may differ, so compare similarities
    want = brute(queries, corpus, 5, True)
    assert {k: sorted(s for _, s in v) for k, v in got.items()} == {k: sorted(s for _, s in v) for k, v in want.items()}
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 10)
    large = retrieval.blocked_top_k(q, c, 5)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 4_000)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, retrieval.blocked_top_k(q, c, 5).collect()))


def test_comparisons_grow_less_than_the_pairs(spark):
    def compared(n):
        x = clustered(np.random.default_rng(5), n, 4, 0.1, centres=60)
        rows = [("a", f"{i:06d}", f"{i:06d}", [float(v) for v in r]) for i, r in enumerate(x) if r.any()]
        c = spark.createDataFrame(rows, "dataset string, ckey string, first_chunk string, vec array<double>")
        q = c.selectExpr("dataset", "ckey AS qkey", "vec")
        out = cells.cell_top_k(q, c, 3, sparse=False).groupBy("qkey").agg({"compared": "max"}).collect()
        return sum(r[1] for r in out), len(rows) ** 2

    (small, few), (large, many) = compared(500), compared(4_000)
    assert large < many / 4 and np.log(large / small) / np.log(many / few) < 0.85


def test_rows_between_stages_follow_groups_not_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ROWS", 200)
    sizes = {}

    def counted(df, name, write=cells.materialize):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(cells, "materialize", counted)
    x = np.random.default_rng(6).normal(size=(600, 32))
    rows = [("a", f"{i:04d}", f"{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    c = spark.createDataFrame(rows, "dataset string, ckey string, first_chunk string, vec array<float>")
    q = c.selectExpr("dataset", "ckey AS qkey", "vec")
    got = found(cells.cell_top_k(q, c, 3, sparse=False))
    want = brute([(d, k, v) for d, k, _, v in rows], rows, 3, False)
    assert got.keys() == want.keys()
    assert all(sorted(s for _, s in got[k]) == pytest.approx(sorted(s for _, s in want[k]), abs=2e-6) for k in want)
    # random vectors rule out no cell of the 25; three to four groups hold them
    assert max(sizes.values()) <= 600 * 4 * 3 and sizes["visits"] <= 600 * 4


def test_empty_sides(spark):
    q = spark.createDataFrame([("a", "q", [1.0])], "dataset string, qkey string, vec array<double>")
    c = spark.createDataFrame([("a", "c", "c", [1.0])], "dataset string, ckey string, first_chunk string, vec array<double>")
    assert cells.cell_top_k(q.limit(0), c, 3, sparse=False).collect() == []
    assert cells.cell_top_k(q, c.limit(0), 3, sparse=False).collect() == []
