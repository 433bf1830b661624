"""Stage catalogue, run registry, recorded replay, file blocks and wide components against plain code."""

import hashlib
import os

import numpy as np
import pytest

from triagelake.operators import pca, registry, scorers
from triagelake.plans import stages
from triagelake.sources.catalogue import Catalogue, StageError
from triagelake.sources.text_logs import block_integrity

EVIDENCE = "dataset string, query_id string, rank int, similarity double, chunk_id string, source_window_id string"


def test_stages_are_checked_read_back_and_removed(spark, tmp_path):
    df = spark.createDataFrame([("d", "q", 1, 0.5, "c", "w")], EVIDENCE)
    with Catalogue(spark, str(tmp_path)) as run:
        assert run.names() == [] and run.write("evidence", df).collect() == df.collect()
        with pytest.raises(StageError, match="lacks"):
            run.write("citations", df)
        with pytest.raises(StageError, match="lacks"):
            Catalogue(spark, str(tmp_path)).write("evidence", df.withColumn("rank", df["rank"].cast("long")))
        with pytest.raises(StageError, match="already"):
            run.write("evidence", df)
        run.write("kept", df.select("query_id"))
        run.keep("kept")
        with pytest.raises(StageError, match="no stage"):
            run.read("bundles")
    assert run.names() == ["kept"]
    run.remove()
    assert os.listdir(tmp_path) == []
    with Catalogue(spark, str(tmp_path)) as run:
        run.write("evidence", df)
    assert os.listdir(tmp_path) == []


def test_a_try_that_failed_is_replaced(spark, tmp_path):
    run = Catalogue(spark, str(tmp_path), "r")
    os.makedirs(f"{run.path}/rows/part")
    assert not run.exists("rows") and run.names() == []
    assert run.write("rows", spark.range(3)).count() == 3


def test_replay_says_unresolved_where_nothing_is_recorded(spark, tmp_path):
    run = Catalogue(spark, str(tmp_path))
    run.write("gated", spark.createDataFrame([("d", "a", "ESCALATE"), ("d", "b", "AUTO-CLEAR")], "dataset string, window_id string, decision string"))
    one = spark.createDataFrame([("d", "a")], "dataset string, window_id string")
    run.status("gate", one.unionByName(spark.createDataFrame([("d", "b")], one.schema)))
    run.status("retrieve", one)
    got = {(r["window_id"], r["stage"]): r["status"] for r in stages.recorded_replay(run).collect()}
    assert got["a", "gate"] == got["b", "gate"] == got["a", "retrieve"] == "COMPLETED"
    assert got["b", "retrieve"] == got["b", "explain"] == "SKIPPED" and got["a", "explain"] == got["b", "score"] == "UNRESOLVED"
    run.remove("status-retrieve")
    assert {(r["window_id"], r["stage"]): r["status"] for r in stages.recorded_replay(run).collect()}["a", "retrieve"] == "UNRESOLVED"


def test_registering_twice_changes_nothing(spark, tmp_path):
    rows = lambda v, seq: spark.createDataFrame([("s", v, seq), ("t", v, seq)], "system string, v double, seq int")
    path = str(tmp_path / "registry")
    assert registry.register(rows(1.0, 1), path, "one") and registry.register(rows(2.0, 2), path, "002")
    before = sorted(map(tuple, registry.registered(spark, path).collect()))
    assert not registry.register(rows(9.0, 9), path, "one")
    assert sorted(map(tuple, registry.registered(spark, path).collect())) == before and len(before) == 4
    last = registry.latest(registry.registered(spark, path), ["system"], ["seq"]).collect()
    assert {(r["system"], r["v"]) for r in last} == {("s", 2.0), ("t", 2.0)}


def test_thresholds_of_a_system_without_one_give_no_decision(spark):
    scored = spark.createDataFrame([("d", "w", "test", 1.0, 2.0)], "dataset string, window_id string, split string, a double, b double")
    t = spark.createDataFrame([("d", "a", "quantile", 0.95, 0.5, 10)], "dataset string, system string, rule string, level double, threshold double, n long")
    assert {(r["system"], r["pred"]) for r in registry.classify_frozen(scored, t, ("a", "b"), "quantile", 0.95).collect()} == {("a", 1), ("b", None)}


@pytest.mark.parametrize("size", [1, 100, 250, 300])
def test_block_digests_of_files(spark, tmp_path, size):
    raw = os.urandom(size)
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in block_integrity(spark, str(tmp_path), 100).collect()}
    parts = [raw[i : i + 100] for i in range(0, max(size, 1), 100)]
    want = hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    assert (got["a.bin"]["digest"], got["a.bin"]["n_blocks"], got["a.bin"]["size_bytes"]) == (want, len(parts), size)


def cells(spark, x):
    rows = [("d", f"w{i}", int(j), float(x[i, j])) for i in range(len(x)) for j in np.flatnonzero(x[i])]
    return spark.createDataFrame(rows, "dataset string, window_id string, idx int, value double").repartition(3)


def test_wide_components_equal_the_singular_values(spark):
    rng = np.random.default_rng(1)
    n, d = 80, 20_000
    x = np.zeros((n, d))
    for i in range(n):
        x[i, rng.choice(d, 40, replace=False)] = rng.random(40)
    x[:, :6] += rng.normal(size=(n, 2)) @ rng.normal(size=(2, 6)) * 3 + 1
    x[:, 19_990] = 2.0
    f = cells(spark, x)
    centred = x - x.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False) ** 2 / n
    fit = scorers.fit_pca(f, d, n_components=4)
    assert np.allclose(fit["eigenvalues"][:2], s[:2], rtol=1e-6) and abs(fit["variance"] - s.sum()) < 1e-6
    got = np.array([r["score"] for r in scorers.pca_scores(f, d, fit).collect()])
    assert abs(got.mean() - (fit["variance"] - fit["eigenvalues"].sum())) < 1e-6
    share = scorers.fit_pca(f, d, variance_ratio=0.6)
    assert share["share"].sum() >= 0.6 - 1e-6 and share["share"][:-1].sum() < 0.6
    whole = scorers.fit_pca(f, d, n_components=n)
    assert max(r["score"] for r in scorers.pca_scores(f, d, whole).collect()) < 1e-6


def test_narrow_and_wide_ways_agree(spark, monkeypatch):
    x = np.random.default_rng(2).random((60, 7)) * np.arange(1, 8)
    x[3] = 0.0
    x[3, 0] = 1.0
    f = cells(spark, x)
    narrow, by_row = scorers.fit_pca(f, 7, n_components=3), lambda fit: {r["window_id"]: r["score"] for r in scorers.pca_scores(f, 7, fit).collect()}
    old = by_row(narrow)
    monkeypatch.setattr(scorers, "MAX_PCA_FEATURES", 1)
    monkeypatch.setattr(pca, "CHUNK", 3)
    wide = scorers.fit_pca(f, 7, n_components=3)
    new = by_row(wide)
    assert wide["k"] == narrow["k"] == 3 and all(abs(old[w] - new[w]) < 1e-6 for w in old)
