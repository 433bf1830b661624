"""Repetition inside a document, read from the suffix array of its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from triagelake.llm.common import WORD, map_batches, only, prepared, texts

MIN_WORDS = 20
REPEAT_WORDS = 8
MAX_COVERED = 0.30
#: a single repeat of at least LONG_WORDS words may span this share of the document
LONG_WORDS, MAX_LONGEST = 50, 0.20
SYMBOLS = re.compile(r"[#*$%&|<>]")


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Suffix array of ``ids`` and the common prefix of each suffix with the one before it.

    Ranks of prefixes of 1, 2, 4, ... words by doubling; the common prefixes come from the kept
    ranks, longest step first. None if no two suffixes share ``least`` words, which the doubling
    sees as soon as all prefixes of at most ``least`` words differ.
    """
    n = len(ids)
    levels, h, rank = [ids], 1, ids
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        h *= 2
        rank = new
        if rank[order[-1]] == n - 1 or h >= n:
            break
        levels.append(rank)
    if h <= least:
        return None
    left, right, lcp = order[:-1], order[1:], np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + lcp[1:], right + lcp[1:]
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        lcp[1:] += same * (1 << k)
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the suffix array whose common prefix is >= least."""
    n = len(lcp)
    runs = np.flatnonzero(lcp >= least)
    for run in np.split(runs, np.flatnonzero(np.diff(runs) > 1) + 1) if len(runs) else ():
        stack: list[tuple[int, int]] = []
        for i in [*run.tolist(), int(run[-1]) + 1]:
            now = int(lcp[i]) if i < n and i <= run[-1] else 0
            first = i - 1
            while stack and stack[-1][0] > now:
                length, first = stack.pop()
                yield length, first, i - 1
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append((now, first))


def repeats(ids: np.ndarray, least: int = REPEAT_WORDS) -> tuple[int, int, int]:
    """(words covered by repeats, longest repeat, number of maximal repeats), of >= least words.

    A repeat is maximal if its occurrences can't all be extended to the right (an interval) nor all
    to the left (two preceding words differ). Occurrences may overlap.
    """
    n = len(ids)
    found = suffix_array(ids, least) if n > least else None
    if found is None:
        return 0, 0, 0
    order, lcp = found
    longest = int(lcp.max())
    if longest < least:
        return 0, 0, 0
    reach = np.maximum(lcp, np.append(lcp[1:], 0))
    reach[reach < least] = 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, order, reach > 0)
    np.add.at(edge, order + reach, -(reach > 0).astype(np.int64))
    before = np.where(order > 0, ids[order - 1], -1 - order)  # a text start differs from any word
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    maximal = sum(bool(changes[b] > changes[a]) for _, a, b in intervals(lcp, least))
    return int((np.cumsum(edge)[:n] > 0).sum()), longest, maximal


def profile(text: str, least: int = REPEAT_WORDS) -> dict:
    words = WORD.findall(text)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    covered, longest, maximal = repeats(ids, least)
    lines, earlier = 0, set()
    for line in text.split("\n"):
        if line in earlier:
            lines += WORD.search(line) is not None
        else:
            earlier.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOLS.findall(text)), "n_dup_lines": lines, "n_repeat_words": covered, "longest_repeat": longest, "n_maximal_repeats": maximal}


def verdict(p: dict, max_covered: float = MAX_COVERED, long_words: int = LONG_WORDS, max_longest: float = MAX_LONGEST) -> tuple[bool, bool]:
    """(base_failed, kept) of one profile."""
    n = p["n_words"]
    failed = n < MIN_WORDS or 100 * p["n_repeat_words"] > 30 * n
    long = p["longest_repeat"] >= long_words and p["longest_repeat"] > max_longest * n
    return failed, not (failed or p["n_repeat_words"] > max_covered * n or long)


def repetition_rules(docs: DataFrame, least: int = REPEAT_WORDS, max_covered: float = MAX_COVERED, long_words: int = LONG_WORDS, max_longest: float = MAX_LONGEST) -> DataFrame:
    """One row per document: word counts, repeats found by the suffix array, and the verdict.

    A document is kept if it passes the base rules, its repeats of ``least`` or more words cover at
    most ``max_covered`` of its words, and no repeat of ``long_words`` or more words is longer than
    ``max_longest`` of it. A null text has no words, so it fails. Rows are judged one by one: equal
    rows give equal rows, and a null doc_id is passed through.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_maximal_repeats")
    prepared(docs.sparkSession)

    def judge(b: pa.RecordBatch) -> dict:
        rows = [profile(t, least) for t in texts(b)]
        marks = [verdict(p, max_covered, long_words, max_longest) for p in rows]
        return {"doc_id": b.column("doc_id")} | {c: pa.array([p[c] for p in rows], pa.int64()) for c in names} | {"base_failed": [m[0] for m in marks], "kept": [m[1] for m in marks]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(only(docs, "doc_id", "text"), judge, f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean")
