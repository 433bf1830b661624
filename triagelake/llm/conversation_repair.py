"""Cheapest repair of the structure of conversations, by depth-first branch and bound."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import BLANK, give_back, only

#: fixed values: what an edit costs, and what an undeleted truncated row adds
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: states of a legal conversation: nothing yet, after the system row, after a user, after an assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: the role that must follow in each state, and the state after it
FOLLOWS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: the insertions that end a conversation lawfully
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: what a prefix can cost above another of the same rows and still win: whatever rows follow, one state's
#: cheapest rest costs at most this above another's (insert the missing turn, delete the system row kept)
SLACK = DELETE + INSERT
#: rows searched at once; a longer conversation is searched piece by piece
PIECE = 256

#: a row as the search sees it: initial of the role, must be deleted, is truncated
Seen = tuple[str, bool, bool]
#: cost and audit of a prefix; the audit has a letter per edit: D, I, K, R
Prefix = tuple[int, str]


def row_choices(row: Seen, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, state after) of the edits that deal with this row."""
    initial, must_go, truncated = row
    out = []
    if not must_go:
        extra = TRUNCATED if truncated else 0
        role, after = FOLLOWS[state]
        if initial == role[0]:
            out.append((KEEP + extra, "K", after))
        elif state == START and initial == "s":
            out.append((KEEP + extra, "K", SYSTEM))
        out.append((REROLE + extra, "R", after))
    out.append((DELETE, "D", state))
    return out


def suffix_bounds(rows: list[Seen], last: bool) -> list[list[int]]:
    """For each position and state a lower bound of what the rest costs, from the last row backwards.

    The bound leaves the audits aside, and unless these are the ``last`` rows what follows them too.
    """
    out = [[INSERT * CLOSING[s] if last else 0 for s in FOLLOWS]]
    for row in reversed(rows):
        here = [min(c + out[-1][after] for c, _, after in row_choices(row, s)) for s in FOLLOWS]
        for _ in range(2):  # two insertions lead from any state to any that more of them would
            here = [min(here[s], INSERT + here[FOLLOWS[s][1]]) for s in FOLLOWS]
        out.append(here)
    return out[::-1]


def search(rows: list[Seen], entry: dict[int, Prefix], last: bool) -> dict[int, Prefix]:
    """The best prefix for each state after these rows that may still win; with ``last`` the one best repair.

    Nodes are (rows dealt with, state). The stack is explicit, the edit of least bound is tried first, of equal ones the least letter. A node is
    left when its cost and the bound of what follows exceed the incumbent (by more than SLACK while more
    rows follow), or when the node's dominance table holds a prefix of less cost, or of the same cost and
    an audit that is less. Two audits of one node and one cost never begin one another (the longer
    one would have more insertions), so the lesser one stays less whatever follows. An insertion is made
    before a row, or at the very end.
    """
    n, bounds = len(rows), suffix_bounds(rows, last)
    tables: list[dict[int, Prefix]] = [{} for _ in range(n + 1)]
    incumbent: Prefix | None = None
    spare = 0 if last else SLACK
    stack = [(0, s, cost, audit) for s, (cost, audit) in sorted(entry.items(), key=lambda e: (e[1][0] + bounds[0][e[0]], e[1][1]), reverse=True)]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None and cost + bounds[i][state] > incumbent[0] + spare:
            continue
        seen = tables[i].get(state)
        if seen is not None and seen <= (cost, audit):
            continue
        tables[i][state] = (cost, audit)
        if i == n:
            closed = (cost + INSERT * CLOSING[state], audit + "I" * CLOSING[state]) if last else (cost, audit)
            if incumbent is None or closed < incumbent:
                incumbent = closed
            continue
        nodes = [(cost + c + bounds[i + 1][after], letter, cost + c, i + 1, after) for c, letter, after in row_choices(rows[i], state)]
        after = FOLLOWS[state][1]
        nodes.append((cost + INSERT + bounds[i][after], "I", cost + INSERT, i, after))
        for least, letter, c, at, after in sorted(nodes, reverse=True):
            if incumbent is None or least <= incumbent[0] + spare:
                stack.append((at, after, c, audit + letter))
    if last:
        return {START: incumbent}
    return {s: p for s, p in tables[n].items() if p[0] <= incumbent[0] + SLACK}


class _Repair:
    """One conversation whose rows arrive in order: what is decided is hashed and let go."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before: str | None = None  # initial of the row before
        self.same = None  # (turn, role, text) of the row before
        self.waiting: list[tuple[str, str]] = []  # role and text of rows whose edit is still open
        self.rows: list[Seen] = []  # of these the ones not yet searched
        self.prefixes: dict[int, Prefix] = {START: (0, "")}
        self.audit: list[str] = []
        self.digest, self.written, self.state = hashlib.sha256(), False, START

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.turn = turn
        end = text.rstrip(BLANK)
        blank = not end
        duplicate = not blank and (repeated or (turn, role, text) == self.same)
        truncated = not blank and not duplicate and end[-1] not in ".!?"
        self.same = (turn, role, text)
        initial = role[:1]
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if len(self.rows) == PIECE:  # known not to be the last ones
            self.prefixes = search(self.rows, self.prefixes, False)
            self.rows = []
            self._settle()
        self.rows.append((initial, blank or duplicate, truncated))
        self.waiting.append((role, text if not (blank or duplicate) else ""))

    def _settle(self) -> None:
        """Apply the edits on which all prefixes that may still win agree."""
        common = os.path.commonprefix([audit for _, audit in self.prefixes.values()])
        self._apply(common)
        self.prefixes = {s: (c, a[len(common) :]) for s, (c, a) in self.prefixes.items()}

    def _apply(self, edits: str) -> None:
        at = 0
        for letter in edits:
            role, text = ("", "") if letter == "I" else self.waiting[at]
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K" and role[:1] == "s":
                self.state = SYSTEM
            else:
                role, self.state = (role if letter == "K" else FOLLOWS[self.state][0]), FOLLOWS[self.state][1]
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.written = True
        del self.waiting[:at]
        self.audit.append(edits)

    def result(self) -> tuple:
        cost, audit = search(self.rows, self.prefixes, True)[START]
        self._apply(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now: _Repair | None = None
    done: list[tuple] = []
    mark_of: tuple | None = None

    def flush() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "mark", "role", "text", "copies", "digest")]
        for conv_id, turn, mark, role, text, copies, digest in zip(*cols, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                now, mark_of = _Repair(conv_id), None
            if mark == 0:
                mark_of = (turn, digest)
            else:
                for _ in range(copies):
                    now.add(turn, role, text, (turn, digest) == mark_of)
        if done:
            yield flush()
            done = []
    if now is not None:
        done.append(now.result())
        yield flush()
    give_back()


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: its faults, the cheapest repair and the digest of the repaired rows.

    ``rows`` has conv_id, turn (longs), role, text and copies: how often the row occurs, one copy beside
    the other; a conversation all of whose rows have 0 copies is empty: zeros, an empty audit, the digest
    of the empty string. A null role or text is one space, a null conv_id is one more conversation, null
    turns come first. Rows of one turn are ordered by role and a digest of the text; equal ones are duplicates. A role
    that begins with none of s, u, a (an empty one too) can't stay. Other columns aren't read.

    Later occurrences of a role and text are found on digests: least turn per text, joined back, so
    one text said by a third of the rows is pre-aggregated and the join may split it. The texts are
    shuffled once: by conversation, sorted by turn, and streamed. The digest of a conversation is one
    sequential hash, so its rows pass through one task in order; that task holds PIECE rows and those
    on which the prefixes that may still win don't agree, never the conversation.
    """
    r = only(rows, "conv_id", "turn", "role", "text", "copies")
    r = r.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.col("copies").cast("int").alias("copies"))
    r = r.withColumn("digest", _digest(F.col("role"), F.col("text")))
    spoken = r.filter((F.col("copies") > 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "digest", "turn", "role").distinct()
    first = spoken.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "first")
    later = spoken.join(first, spoken["conv_id"].eqNullSafe(F.col("_c")) & (spoken["digest"] == F.col("_d"))).filter(F.struct("turn") > F.col("first"))
    marks = later.select("conv_id", "turn", F.lit(0).alias("mark"), "role", F.lit("").alias("text"), F.lit(0).alias("copies"), "digest")
    stream = marks.unionByName(r.withColumn("mark", F.lit(1)))
    stream = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "mark")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64() if c in RESULT[:6] else pa.string()) for c in RESULT]])
    fields = ", ".join(f"{c} {'bigint' if c in ('conv_id', *RESULT[:6]) else 'string'}" for c in ("conv_id", *RESULT))
    return stream.mapInArrow(lambda batches: _repairs(batches, schema), fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that crc32 of ``conv_id:turn`` gives each: the input of :func:`repair`.

    By its remainder modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    it, 4 makes its role user. Nulls are one space, in the hashed key too.
    """
    c = only(conversations, "conv_id", "turn", "role", "text")
    blank = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
