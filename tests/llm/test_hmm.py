"""Operator 9 against plain recursions and plain counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from triagelake.llm import common, hmm


def random_model(rng, k, c):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))))


def all_paths(m, seq):
    """Probability of every state path of one sequence."""
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[path[0], seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, c]
        yield path, p


def test_expected_counts_and_likelihood_equal_the_sum_over_paths():
    rng = np.random.default_rng(9)
    for _ in range(20):
        m = random_model(rng, 2, 3)
        seqs = [rng.integers(0, 3, rng.integers(1, 7)) for _ in range(4)]
        start, move, emit, like = hmm.expected_counts(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
        s2, m2, e2, l2 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), []
        for s in seqs:
            total = sum(p for _, p in all_paths(m, s))
            l2.append(math.log(total))
            for path, p in all_paths(m, s):
                s2[path[0]] += p / total
                for a, b in zip(path, path[1:]):
                    m2[a, b] += p / total
                for a, c in zip(path, s):
                    e2[a, c] += p / total
        np.testing.assert_allclose(start, s2), np.testing.assert_allclose(move, m2), np.testing.assert_allclose(emit, e2)
        assert math.isclose(like, sum(l2))
        for chunk in (1, 2, 3, 100):
            np.testing.assert_allclose(hmm.log_likelihoods(m, np.concatenate(seqs), np.array([len(s) for s in seqs]), chunk), l2)


def test_runs_cut_long_texts():
    rng = np.random.default_rng(1)
    m = random_model(rng, 3, 5)
    seq = rng.integers(0, 5, 1000)
    cut = np.array([256, 256, 256, 232])
    for a, b in zip(hmm.expected_counts(m, seq, np.array([1000])), hmm.expected_counts(m, seq, cut)):
        np.testing.assert_allclose(a, b)


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def corpus():
    rng = random.Random(9)
    tongues = [["the", "of", "And", "house"], ["der", "und", "Haus", "é"]]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) if rng.random() < 0.8 else f"r{rng.randint(0, 200)}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "the of " * 3000), (7, rows[7][1]), (7, rows[7][1]), (None, "the Haus"), (None, "other words")]


def test_base_score_equals_plain_counts_and_model_beats_it(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double").repartition(4)
    got = hmm.score_texts(df, states=3, top_words=5, rare_classes=4, iterations=6).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [words(t) for i, t in rows if not out(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = words(t)
        want[(i, out(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in got if r["held_out"]]
    assert len(gain) > 10 and np.mean(gain) > 0.02
    assert hmm.score_texts(df.limit(0), iterations=1).count() == 0


def test_model_score_is_a_probability():
    """All texts of at most two tokens, known, unknown and end, sum to what the end leaves."""
    vocab = hmm.Vocabulary(np.array([5, 9], np.uint64), np.array([4, 3]), np.array([2, 0]), np.array([1, 0]), 3, 12, 4)
    m = random_model(np.random.default_rng(2), 2, vocab.classes)
    texts = [np.array([a, b, 4]) for a in range(4) for b in range(4)] + [np.array([a, 4]) for a in range(4)] + [np.array([4])]
    p = np.exp(hmm.log_likelihoods(m, np.concatenate(texts), np.array([len(t) for t in texts])))
    stop = sum(x for t in itertools.product(range(4), repeat=3) for _, x in all_paths(m, t))
    assert math.isclose(p.sum() + stop, 1.0)


def test_training_raises_the_likelihood(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    counts, _ = hmm.write_stage(hmm.word_counts(df), "counts")
    vocab = hmm.fit_vocabulary(counts, df.count(), 20, 8)
    _, seen = hmm.baum_welch(df, vocab, 3, 5)
    assert len(seen) == 5 and all(b > a - 1.0 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 10


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    batch = ["".join(rng.choice("ab É\n\t\x0b漢") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "x" * 50]
    for lower in (False, True):
        h, n = common.word_hashes(batch, lower)
        plain = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if lower and "A" <= c <= "Z" else c for c in t)) for t in batch]
        assert n.tolist() == [len(w) for w in plain]
        flat = [w for t in plain for w in t]
        assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))
