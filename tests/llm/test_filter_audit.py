"""Filter interactions against brute force over all orders."""

import random
import re
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from triagelake.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if doc_id is not None and any((o or "") == t and i is not None and i < doc_id for i, o, _ in docs):
            f.add("E")
        said = [x for x in labels if x[0] is not None and x[0] == doc_id]
        fails.append((lang or "", f, any(q == 1 for _, q, _ in said), any(x == 1 for _, _, x in said)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, total = [x for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                gone = [x for x in mine if x[1] & set(order[: step - 1])]
                total[f] += len(here)
                out[part, "".join(order), step] = [len(kept), len(here), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in here), sum(x[3] for x in here)]
                left = kept
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def audit(spark, docs, labels):
    d = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in docs], DOCS).select("*", *[F.lit(1).alias(c) for c in ("quality", "toxic", "mask", "part", "digest")])
    x = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("no"))
    rows = filter_audit.interaction_audit(filter_audit.failure_counts(d, x)).collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {tuple(r)[:3]: list(r)[3:] for r in rows}


def test_every_order_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["one", "Two", "THREE", "é", "#4", "five", "six", "seven", "a|b"]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 6, 9])]) + (str(rng.randrange(300)) if rng.random() < 0.6 else "") for _ in range(rng.choice([3, 190, 200, 400]))) for _ in range(50)]
    texts += ["", None, "\t\n", "x " * 200]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(160)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (3, docs[3][1], "en"), (3, docs[3][1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(160), 90)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = audit(spark, docs, labels)
    assert got == brute(docs, labels) and len(got) == 3 * 600


def test_empty_tables(spark):
    assert audit(spark, [], []) == {}
    got = audit(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_orders_through_the_edges():
    for n in range(1, 7):
        edges = filter_audit.lattice("ABCDEF"[:n])
        for e in edges:
            k = bin(e["before"]).count("1")
            assert e["orders"] == factorial(k) * factorial(n - k - 1)
        assert len(edges) == n * 2 ** (n - 1)


def test_a_very_long_text(spark):
    docs = [(1, "word " * 1_000_000, "en"), (2, "word " * 1_000_000, "en")]
    assert audit(spark, docs, []) == brute(docs, [])
