"""Operator 3 against brute force over all pairs."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import near_dup as N


def shingles(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(a, b, idf):
    weigh = lambda c: {s: (1 + log(n)) * idf(s) for s, n in c.items()}
    x, y = weigh(a), weigh(b)
    both = sum(min(x[s], y[s]) for s in x if s in y)
    whole = sum(x.values()) + sum(y.values()) - both
    return both / whole if whole else 0.0


def exact_idf(texts):
    """1 + ln(N / df) of every shingle over the distinct texts."""
    distinct = {t or "" for t in texts}
    freq = Counter(s for t in distinct for s in shingles(t))
    return lambda s: 1 + log(len(distinct) / freq[s])


def corpus(n_groups=14, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    common = [word() for _ in range(12)]
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        if g % 3 == 0:
            base[5:5] = common
        for _ in range(rng.choice([1, 2, 5, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += ["a b c", "a b c d", "a  b c", "is on he " * 60 + " ".join(word() for _ in range(60)), "is on he " * 60 + " ".join(word() for _ in range(60)), " ", "\t"]
    return texts


def brute_classes(texts, idf):
    """Class of each text by all pairs."""
    distinct = sorted(set(texts))
    sh = [shingles(t) for t in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if brute_similarity(sh[i], sh[j], idf) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
    return {t: root(i) for i, t in enumerate(distinct)}


@pytest.mark.parametrize("seed,rounds", [(3, 3), (4, 1)])
def test_classes_equal_all_pairs(spark, seed, rounds):
    texts = corpus(seed=seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(30)] + [(2000, None), (2001, ""), (None, texts[0]), (3, texts[3]), (None, "only null ids"), (None, "only null ids")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(4)
    idf = exact_idf([t for _, t in rows])
    want = brute_classes([t or "" for _, t in rows], idf)
    least = {}
    for i, t in rows:
        if i is not None:
            least[want[t or ""]] = min(i, least.get(want[t or ""], i))
    got = N.near_duplicates(df, rounds=rounds).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((i, least.get(want[t or ""])) for i, t in rows)
    kept = N.keep_one(df, rounds=rounds)
    assert kept.schema == df.schema
    have = Counter(want[r["text"] or ""] for r in kept.collect())
    assert set(have.values()) == {1} and set(have) == set(want.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.keep_one(df).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    other = list(words)
    for i in rng.sample(range(150), 6):
        other[i] = "x"
    batch = [" ".join(words), " ".join(other), " ".join(words[:60] * 3)]
    h, tf, n = N.vectors(batch)
    idf = lambda _: 1 + log(2)
    drawn = N.samples(h, N.weights(tf, np.full(len(h), 3), 6), n, 4000)
    df = [np.full(k, 3, np.int64).tobytes() for k in n]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        s = brute_similarity(shingles(batch[a]), shingles(batch[b]), idf)
        assert abs((drawn[a] == drawn[b]).mean() - s) < 0.03
        assert abs(N.similarities([batch[a]], [batch[b]], [df[a], df[b]], 6)[0] - s) < 1e-9


@pytest.mark.parametrize("block", [N.BLOCK_BYTES, 300])
def test_frequencies_are_exact_for_every_shingle(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(400, None), (401, "x y z")]
    found, total = N.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    distinct = {t or "" for _, t in rows}
    assert total == len(distinct) and {r["text"]: r["doc_id"] for r in found.collect()} == {u: min(i for i, t in rows if (t or "") == u) for u in distinct}
    assert found.select("block").distinct().count() == 1 if block > 300 else found.select("block").distinct().count() > 5
    got = {}
    for r in sorted(N.document_frequencies(found).collect(), key=lambda r: (r["block"], r["slice"])):
        got.setdefault(r["block"], []).extend(N._numbers(r["df"], np.int64))
    for b in {r["block"] for r in found.collect()}:
        inside = [r["text"] for r in found.filter(f"block = {b}").collect()]
        count = Counter(s for t in distinct for s in shingles(t))
        assert sorted(got.get(b, [])) == sorted(count[s] for s in set().union(*[shingles(t) for t in inside]))


def test_texts_that_share_a_rare_passage_stay_apart(spark):
    """90 shared and 10 own shingles each, in six of 700 texts: 0.77 similar, whatever share of the rows that is."""
    shared = [f"s{i}" for i in range(94)]
    alike = [" ".join(shared + [f"own{g}_{i}" for i in range(10)]) for g in range(6)]
    rows = list(enumerate(alike + [" ".join(f"o{g}_{i}" for i in range(40)) for g in range(694)]))
    sims = [brute_similarity(shingles(alike[0]), shingles(t), exact_idf([t for _, t in rows])) for t in alike[1:]]
    assert max(sims) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert N.near_duplicates(df).select("class_id").distinct().count() == 700 and N.keep_one(df).count() == 700


@pytest.mark.parametrize("many", [40, 400])
def test_copies_do_not_change_the_weights(spark, many):
    """Frequencies are over distinct texts, so how often a text is repeated changes no class."""
    texts = corpus(5, seed=7)
    rows = list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(many)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("doc_id < 1000").collect()
    want = brute_classes(texts, exact_idf(texts))
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(want[t], i)
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: first[want[t]] for i, t in enumerate(texts)}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    first = N.components(spark.createDataFrame(edges[::2], "a long, b long"))
    again = N.components(spark.createDataFrame(edges[1::2], "a long, b long"), first)
    assert {r["node"]: r["label"] for r in again.collect()} == want
    assert N.components(spark.createDataFrame([], "a long, b long"), again) is again


def test_a_block_holds_about_four_megabytes(spark):
    """A task counts and signs a whole block, at some 25 times its bytes."""
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id", F.repeat(F.lit(" word"), 2000)).alias("text"))
    found, total = N.distinct_texts(df)
    sizes = found.groupBy("block", "slices").agg(F.sum(F.octet_length("text")).alias("s")).collect()
    assert total == 800 and sum(r["s"] for r in sizes) > 8_000_000
    assert len(sizes) == 2 and max(r["s"] for r in sizes) < 5_000_000 and {r["slices"] for r in sizes} == {1}
