"""Conversation repair and chat formatting against brute force, on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from triagelake.llm import chat_format, conversation_repair

LEGAL = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """The rows after damage, in order, and every conv_id."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return out


def faults(rows):
    said, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        if not end:
            out.append("blank")
        elif (role, text) in said:
            out.append("duplicate")
        else:
            out.append("" if end[-1] in ".!?" else "truncated")
        said.add((role, text))
    return out


def cheapest_by_enumeration(rows, found):
    """Every sequence of edits with up to two insertions at a place."""
    inserts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for before in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(("D", "K", "Ruser", "Rassistant"), repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(found, edits)):
                continue
            cost, audit, final = 0, "", []
            for k in range(len(rows) + 1):
                audit, cost, final = audit + "I" * len(before[k]), cost + 3 * len(before[k]), final + [(r, "") for r in before[k]]
                if k < len(rows):
                    e = edits[k]
                    audit += e[0]
                    cost += 4 if e == "D" else (3 if e[0] == "R" else 0) + (3 if found[k] == "truncated" else 0)
                    if e != "D":
                        final.append((rows[k][1] if e == "K" else e[1:], rows[k][2]))
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in final)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, final)
    return best


def cheapest_by_table(rows, found):
    """Least (cost, audit) per number of rows and state, for longer conversations."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    table = {"": (0, "", [])}

    def inserted(t):
        for _ in range(3):
            for s, (c, a, f) in list(t.items()):
                new, old = (c + 3, a + "I", [*f, ({"u": "user", "a": "assistant"}[follows[s]], "")]), t.get(follows[s])
                if old is None or new[:2] < old[:2]:
                    t[follows[s]] = new
        return t

    for (_, role, text), fault in zip(rows, found):
        new = {}
        for s, (c, a, f) in inserted(dict(table)).items():
            options = [(c + 4, a + "D", f, s)]
            if fault not in ("blank", "duplicate"):
                extra, name = (3 if fault == "truncated" else 0), {"u": "user", "a": "assistant"}[follows[s]]
                options.append((c + 3 + extra, a + "R", [*f, (name, text)], follows[s]))
                if role[:1] == follows[s] or (s == "" and role[:1] == "s"):
                    options.append((c + extra, a + "K", [*f, (role, text)], role[:1]))
            for cost, audit, final, at in options:
                if at not in new or (cost, audit) < new[at][:2]:
                    new[at] = (cost, audit, final)
        table = new
    table = inserted(table)
    return min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])


def expected(rows, cheapest):
    out = {}
    for conv, here in damage(rows).items():
        found, turns = faults(here), [t for t, _, _ in here if t is not None]
        cost, audit, final = cheapest(here, found)
        initials = [r[:1] for _, r, _ in here]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[found.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest(),
        )
    return out


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("mark", "copies", "digest", "_c", "first", "message", "seq", "kind")])
    out = conversation_repair.repair(conversation_repair.damaged(df)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in out}, out


def some_rows(rng, conv, n, gap=0.1):
    texts = ["Yes.", "No!", "cut off", "", "\t ", "Why?", "one\ntwo.", "a long answer. ", "é…"]
    return [(conv, t + int(rng.random() < gap), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts) + rng.choice(["", f" {rng.randrange(40)}."])) for t in range(n)]


def test_repair_equals_enumeration_of_all_edits(spark):
    rng = random.Random(5)
    rows = [r for conv in range(60) for r in some_rows(rng, conv, rng.choice([1, 2, 3]), gap=0)]
    sizes = {conv: len(here) for conv, here in damage(rows).items()}
    three = [c for c, n in sizes.items() if n == 3][:3]
    rows = [r for r in rows if sizes[r[0]] < 3 or r[0] in three]
    got, _ = run(spark, rows)
    assert got == expected(rows, cheapest_by_enumeration)


def test_repair_of_longer_conversations(spark, monkeypatch):
    rng = random.Random(6)
    rows = [r for conv in range(60) for r in some_rows(rng, conv, rng.randrange(3, 40), gap=0)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    want = expected(rows, cheapest_by_table)
    assert run(spark, rows)[0] == want


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_of_a_conversation_give_the_same_repair(piece, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rng = random.Random(piece)
    for conv in range(200):
        rows = [(t, role, text) for _, t, role, text in some_rows(rng, conv, rng.randrange(0, 30), gap=0)]
        found, said, one = faults(rows), set(), conversation_repair._Repair(conv)
        for t, role, text in rows:
            one.add(t, role, text, (role, text) in said)
            said.add((role, text))
        cost, audit, final = cheapest_by_table(rows, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        assert one.result()[6:] == (cost, audit, digest)


def test_a_long_conversation_is_let_go_piece_by_piece():
    rng, one, most = random.Random(1), conversation_repair._Repair(1), 0
    for t in range(20_000):
        role = "user" if rng.random() < 0.05 else ("user", "assistant")[t % 2]
        one.add(t, role, f"{t}." if rng.random() < 0.95 else "", False)
        most = max(most, len(one.waiting))
    assert most <= 3 * conversation_repair.PIECE and one.result()[6] > 0


def test_nulls_ties_repeats_long_texts_empty_and_clashing_names(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", None), (1, 5, "assistant", "b." * 400_000), (2, 4, "user", "Hi."), (2, 4, "user", "Hi."), (2, 9, "user", "Hi.")]
    got, out = run(spark, rows, extra=True)
    assert len(out) == 3
    want = expected([r for r in rows if r[0] != 1], cheapest_by_table)
    assert {k: got[k] for k in want} == want
    assert got[1][1:4] == expected([r for r in rows if r[0] == 1], cheapest_by_table)[1][1:4]
    assert run(spark, [])[1] == []
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert run(spark, [(7, gone, "user", "Hi.")])[0] == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(9).alias(c) for c in ("message", "seq", "kind", "segments", "tie", "k")])
    out = chat_format.render(chat_format.fold_events(chat_format.conversation_log(df)))
    seg = F.col("segments")
    return {r[0]: r for r in out.select("conv_id", chat_format.formatted(seg).alias("f"), chat_format.read_turns(chat_format.formatted(seg)).alias("t"), chat_format.masked_text(seg).alias("m")).collect()}


def test_format_reads_back_whatever_the_texts_hold(spark):
    rng = random.Random(3)
    parts = ["\\", "\\\\", "#", "### ", "### assistant: ", "</turn>\n", "<", "\\h", "\\l", "\\c", ":", "\n", "a", " ", "é😀", "$1", "\x00"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b", "### x", None]), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for c in range(80) for t in range(rng.randrange(1, 6))]
    rows += [(500, 1, "assistant", "long #\\ " * 100_000), (500, 0, "user", None), (None, None, "user", "x"), (None, 1, "assistant", "y")]
    got = formatted(spark, rows)
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        mine = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["m"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["f"].count("</turn>") == len(mine) and r["f"].count("### ") == len(mine)
    assert formatted(spark, []) == {}


def test_ties_and_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c")]
    r = formatted(spark, rows)[1]
    assert sorted(t["text"] for t in r["t"]) == ["a", "b", "c", "c"] and r["m"] == "cc"


def test_fold_of_mixed_deltas_edits_and_regenerations(spark):
    rng, log, want = random.Random(4), [], {}
    for conv in range(30):
        state, order, roles = {}, [], {}
        for seq in range(rng.randrange(1, 60)):
            m, kind, text = rng.randrange(5), rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), rng.choice(["a", "b ", "", None])
            role = rng.choice([None, "user", "assistant"])
            log.append((conv, m, seq, kind, role, text))
            if m not in state:
                state[m] = ""
                order.append((m, seq))
            roles[m] = roles.get(m) or role
            state[m] = "" if kind == "regenerate" else (text or "") if kind == "edit" else state[m] + (text or "")
        want[conv] = [(s, roles[m] or "", state[m]) for m, s in order]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, message int, seq long, kind string, role string, text string").repartition(5)
    got = {}
    for r in chat_format.fold_events(df).collect():
        got.setdefault(r["conv_id"], []).append((r["first"], r["role"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    plan = chat_format.render(chat_format.fold_events(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
