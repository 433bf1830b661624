"""Operator 8 against brute force over all alignments."""

import itertools
import random
import re

import pytest

from triagelake.llm import decontaminate as D


def brute(docs, items, least=D.MIN_OVERLAP, most=D.MAX_SUBSTITUTED):
    """All alignments of all items, without seeds."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for (d, t), (i, u) in itertools.product(docs, items):
        a, b = split(t), split(u)
        n = min(len(b), least)
        for p in range(len(a) - n + 1) if n else ():
            for q in range(len(b) - n + 1):
                k = sum(x == y for x, y in zip(a[p : p + n], b[q : q + n], strict=True))
                if k >= n - int(n * most + 1e-9):
                    out[(d, i)] = max(out.get((d, i), (0, 1)), (k, -p))
    return sorted((d, i, -p, min(len(split(dict(items)[i])), least), k) for (d, i), (k, p) in out.items())


@pytest.mark.parametrize("limit", [D.BROADCAST_SEEDS, 0])
def test_overlaps_equal_brute_force(spark, limit):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyzäöü") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 8, 12, 30])))) for i in range(12)] + [(50, ""), (51, None)]
    docs = []
    for d in range(60):
        t = [word() for _ in range(rng.choice([0, 5, 20, 60]))]
        if d % 2:
            passage = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 1, 2, 5])):
                passage[rng.randrange(len(passage))] = "zzz"
            at = rng.randint(0, len(t))
            t[at:at] = passage
        docs.append((d, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, items[0][1].upper()), (3, docs[3][1])]
    df = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame([*items, items[4]], "item_id long, text string")
    got = D.overlaps(df, bench, broadcast_seeds=limit)
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "start", "n_tokens", "n_equal").collect()) == brute(docs, items)
    kept = D.decontaminated(df, bench, broadcast_seeds=limit)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {r[0] for r in brute(docs, items)}
    long_items = [(i, t) for i, t in items if len((t or "").split()) >= 8]
    assert sorted({(r["doc_id"], r["item_id"]) for r in D.overlaps(df, bench, min_tokens=8).collect()}) == sorted({r[:2] for r in brute(docs, long_items)})
    assert D.overlaps(df.limit(0), bench).count() == 0 and D.overlaps(df, bench.limit(0)).count() == 0


def test_masks_survive_any_two_substitutions():
    for bad in itertools.combinations(range(D.MIN_OVERLAP), 2):
        assert any(all(o + j not in bad for j, c in enumerate(m) if c == "1") for m in D.MASKS for o in range(D.MIN_OVERLAP - len(m) + 1))


def test_null_ids_and_substitutions(spark):
    item = " ".join(f"w{i}" for i in range(20))
    hit = item.replace("w7", "q").replace("w13", "q")
    miss = " ".join("q" if i % 3 == 0 else f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, "x y " + hit), (1, miss), (2, "z " * 5000 + item)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in D.overlaps(df, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()}
    assert set(got) == {None, 2} and got[None]["n_equal"] >= 11 and got[2]["start"] == 5000


@pytest.mark.parametrize("limit", [D.BROADCAST_SEEDS, 0])
def test_short_items_are_found_in_longer_texts(spark, limit):
    rng = random.Random(18)
    items = [(n, " ".join(f"i{n}t{j}" for j in range(n))) for n in range(1, 14)] + [(50, ""), (51, None)]
    docs = [(9000, None), (9001, ""), (9002, items[2][1])]
    for n, t in items[:13]:
        spare = int(min(n, D.MIN_OVERLAP) * D.MAX_SUBSTITUTED + 1e-9)
        for k in range(spare + 2):
            for bad in rng.sample(list(itertools.combinations(range(n), k)), min(6, len(list(itertools.combinations(range(n), k))))):
                words = ["q" if j in bad else w for j, w in enumerate(t.split())]
                docs.append((len(docs), " ".join(["x"] * rng.randint(0, 9) + words + ["y"] * rng.randint(0, 9))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.overlaps(df, bench, broadcast_seeds=limit)
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "start", "n_tokens", "n_equal").collect()) == brute(docs, items)


def test_own_masks_survive_all_allowed_substitutions():
    for n in range(1, D.MIN_OVERLAP):
        for bad in itertools.combinations(range(n), int(n * D.MAX_SUBSTITUTED + 1e-9)):
            assert any(all(m[j] == "0" for j in bad) and "1" in m for m in D.length_masks(n))
