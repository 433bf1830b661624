"""Operator 6 against full alignment and full search."""

import random

import numpy as np

from triagelake.llm import licenses as L


def full_score(a, b):
    """Smith-Waterman over the whole matrix."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(6)
    for _ in range(300):
        t = [rng.randint(1, 9) for _ in range(rng.randint(3, 20))]
        d = list(t)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(d))
            rng.choice([lambda: d.insert(at, 0), lambda: d.__setitem__(at, 0), lambda: d.pop(at) if len(d) > 1 else None])()
        lead = [0] * rng.randint(0, 9)
        score, equal, first, end = L.align(t, lead + d, len(lead), 40)
        assert score == full_score(t, lead + d)
        assert L.align(t, lead + d, len(lead), L.BAND)[0] == score  # three edits stay in the band
        assert 0 <= first < end <= len(lead + d) and equal <= len(t)


def test_winnowing_shares_a_fingerprint_for_every_long_enough_run():
    rng = np.random.default_rng(6)
    for _ in range(300):
        run = rng.integers(1, 50, L.GRAM + L.WINDOW - 1)
        a, b = (np.concatenate((rng.integers(0, 50, rng.integers(0, 9)), run, rng.integers(0, 50, rng.integers(0, 9)))) for _ in range(2))
        assert set(L.winnow(a)[1].tolist()) & set(L.winnow(b)[1].tolist())


def brute_has(text, name):
    """Full alignment of one template with the whole text reaches the coverage."""
    words = L._TOKEN.findall(text.lower())
    body = L._TOKEN.findall(L.TEMPLATES[name].lower())
    return any(words[i : i + len(body)] == body for i in range(len(words) - len(body) + 1))


def test_every_template_is_found_whole_and_edited(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "software", "license"]) for _ in range(n))
    rows = [(i, f"{filler(rng.randint(0, 40))}.\n{t.upper()}! {filler(rng.randint(0, 300))}") for i, t in enumerate(L.TEMPLATES.values())]
    edited = L.TEMPLATES["MIT"].replace("free of charge", "gratis").replace("merge, ", "")
    rows += [(50, f"x {edited} y"), (51, None), (52, ""), (53, "a b"), (54, "İ" * 9 + " Released under the MIT License"), (55, "word " * 40000 + "Released under the MIT License."), (None, "Released under the MIT License. Released under the MIT License.")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, coverage double").repartition(3)
    got = L.license_notices(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    names = list(L.TEMPLATES)
    for i, t in rows:
        found = {r["license"] for r in by.get(i, [])}
        assert {n for n in names if t and brute_has(t, n)} <= found
    for i, name in enumerate(names):
        mine = next(r for r in by[i] if r["license"] == name)
        assert mine["coverage"] == 1.0 and L._TOKEN.findall(rows[i][1][mine["start"] : mine["end"]].lower()) == L._TOKEN.findall(L.TEMPLATES[name].lower())
    assert by[50][0]["license"] == "MIT" and 0.9 < by[50][0]["coverage"] < 1
    assert not {51, 52, 53} & set(by) and by[54][0]["start"] == 10 and by[55][0]["start"] == 200000
    assert [r["start"] for r in sorted(by[None], key=lambda r: r["start"])] == [0, 32]
    assert L.license_notices(df.limit(0)).count() == 0


def found_in(text):
    return {r["license"] for r in L.find_notices(text, L.build_index())}


def test_rights_reserved_with_and_without_a_holder():
    assert "all-rights-reserved-short" in found_in("A page about nothing.\nAll rights reserved")
    assert "all-rights-reserved-short" in found_in("Copyright 2024 Acme Corp. All rights reserved")
    assert "all-rights-reserved-short" not in found_in("All rights and all seats are reserved")


def test_short_notices_survive_any_neighbour_and_any_substitution_that_leaves_the_coverage():
    index = L.build_index()
    every = sorted(index.words)
    for name, body in zip(index.names, index.bodies, strict=True):
        if len(body) > L.SHORT:
            continue
        words = L._TOKEN.findall(L.TEMPLATES[name].lower())
        if len(body) < L.GRAM + L.WINDOW - 1:  # only such templates lost fingerprints to neighbours
            for w in every[::7] + ["the", "source", "software"]:
                assert name in {r["license"] for r in L.find_notices(f"{' '.join(words)} {w} {w}", index)}, (name, w)
        rng = random.Random(name)
        for _ in range(10):
            t = list(words)
            for at in rng.sample(range(len(t)), int(len(t) * (1 - L.MIN_COVERAGE) + 1e-9)):
                if 0 < at < len(t) - 1:
                    t[at] = "zzz"
            _, equal, _, _ = L.align(index.bodies[index.names.index(name)], [index.words.get(w, 0) for w in t], 0)
            if equal >= L.MIN_COVERAGE * len(t):
                assert name in {r["license"] for r in L.find_notices(" ".join(t), index)}, t


def test_whole_license_texts_are_found():
    for n in L.FULL_TEXTS:
        text = "/* " + L.TEMPLATES[f"{n}-text"].replace("\n", "\n * ") + " */ int main() {}"
        assert f"{n}-text" in found_in(text)
    assert "GPL-3.0-text" not in found_in(L.TEMPLATES["GPL-2.0-text"])
