"""Operators 2, 4 and 5 against brute force on small inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from triagelake.llm import line_dedup, pii, quality

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [(a, e, kind) for a, _, e, kind in sorted(out)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "x.y+z@mail-1.example.org", "@", ".", "..", "10.0.0.1", "999.1.2.3.4", "1.2..3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (487) 555-7209", "+49", "+", " ", "-", "5", "0", "é", "İ", "token = \"abc123def456\"", "a", "(", "http://u@h.de/x.", "000001.2.3.4"]
    anchors = pii.automaton()
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in pii.find_spans(t, anchors) if s[2] in BASE] == base_spans(t), t


def test_pii_added_kinds_and_redaction(spark):
    t = 'mail me@x.org or http://a.b/c?d=1. IBAN: DE89 3704 0044 0532 0130 00, token = "24be64439e3e49cf"'
    got = pii.find_spans(t, pii.automaton())
    assert [(k, t[a:b]) for a, b, k in got if k not in BASE] == [("url", "http://a.b/c?d=1"), ("account", "DE89 3704 0044 0532 0130 00"), ("secret", "24be64439e3e49cf")]
    assert pii.redacted("to me@x.org now", pii.find_spans("to me@x.org now", pii.automaton())) == "to <email> now"
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "+1 234 567 8901", 6)], "doc_id long, text string, spans long")
    rows = sorted((r["doc_id"] or 0, len(r["spans"]), r["redacted"]) for r in pii.personal_data(df).collect())
    assert rows == [(0, 1, "<phone>"), (1, 0, ""), (1, 0, "")]
    assert pii.base_digest([]) == hashlib.sha256(b"").hexdigest()


def brute_repeats(ids, least):
    n = len(ids)
    windows = {}
    for i in range(n - least + 1):
        windows.setdefault(tuple(ids[i : i + least]), []).append(i)
    covered = {j for w in windows.values() if len(w) > 1 for i in w for j in range(i, i + least)}
    subs = {}
    for a in range(n):
        for b in range(a + least, n + 1):
            subs.setdefault(tuple(ids[a:b]), []).append(a)
    rep = {s: p for s, p in subs.items() if len(p) > 1}

    def maximal(s, p):
        left = {ids[i - 1] if i else None for i in p}
        right = {ids[i + len(s)] if i + len(s) < n else None for i in p}
        return (len(left) > 1 or None in left) and (len(right) > 1 or None in right)

    return len(covered), max(map(len, rep), default=0), sum(maximal(s, p) for s, p in rep.items())


@pytest.mark.parametrize("least", [1, 2, 3, 8])
def test_repeats_equal_brute_force(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        ids = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).astype(np.int64)
        assert quality.repeats(ids, least) == brute_repeats(ids.tolist(), least), ids.tolist()


def test_quality_rows(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    copy = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, clean, "x"), (2, None, "y"), (3, "", "y"), (4, f"{copy}\n{copy}\n \n \n{copy}", "z"), (5, "a# b|\x0bc", "z"), (1, clean, "x")], "doc_id long, text string, kept string")
    rows = {r["doc_id"]: r for r in quality.repetition_rules(df).collect()}
    assert rows[1]["kept"] and not rows[1]["base_failed"] and rows[1]["n_words"] == 40
    assert rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[2]["base_failed"] and not rows[3]["kept"]
    assert rows[4]["n_repeat_words"] == 30 and rows[4]["n_dup_lines"] == 2 and rows[4]["base_failed"]
    assert rows[5]["n_words"] == 3 and rows[5]["n_symbols"] == 2 and rows[5]["word_chars"] == 5
    long = " ".join(f"a{i}" for i in range(150))
    assert quality.verdict(quality.profile(long))[1]
    assert not quality.verdict(quality.profile(long + " " + " ".join(f"a{i}" for i in range(60))))[1]
    assert quality.repetition_rules(df.limit(0)).count() == 0


def brute_lines(rows, least=20, docs=3):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, lines in split:
        for x in lines:
            held.setdefault(key(x), set()).add(-1 if i is None else i)
    out = []
    for i, lines in split:
        own = -1 if i is None else i
        stay = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= docs and max(held[key(x)]) != own)]
        out.append((own, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 8])
def test_line_dedup_equals_brute_force(spark, bits):
    rng = random.Random(5)
    pool = [f"  Line number {i} with ÄÖ and Words\t" for i in range(12)] + ["short", "", "x" * 20, "X" * 20 + " ", "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(None, pool[0]), (3, pool[1]), (3, pool[1]), (77, None), (78, "\n" * 3), (79, pool[2] * 200)]
    df = spark.createDataFrame([(*r, "key", 1) for r in rows], "doc_id long, text string, key string, n_lines int").repartition(5)
    got = line_dedup.dedup_lines(df, bits=bits)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_twice_seen_holds_every_repeat(spark):
    lines = [f"the line with the number {i} in it" for i in range(300)]
    df = spark.createDataFrame([(i, lines[i % 200]) for i in range(300)], "doc_id long, text string").repartition(7)
    bitmap = line_dedup.twice_seen(df, bits=14)
    test = lambda t: bool(line_dedup._test(bitmap, line_dedup._positions([line_dedup.xxhash.xxh3_128_digest(t.encode())], 14))[0])
    assert all(map(test, lines[:100])) and not all(map(test, lines[100:200]))
