"""Chat formatting from event logs. Only DataFrame functions on this path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import only

#: the template: a turn is HEAD, role, COLON, text, TAIL. Escaped texts hold no < and no #, escaped roles no colon
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
#: what stands for a control character inside texts; a backslash itself is doubled
ESCAPES = {"#": r"\h", "<": r"\l", ":": r"\c"}
#: a streamed piece of text holds at most this many code points
DELTA = 512


def escape(text: Column, controls: str = "#<") -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(ESCAPES[c]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`. Between doubled backslashes, found from the left, every single one begins an escape."""

    def plain(piece: Column) -> Column:
        for c, e in ESCAPES.items():
            piece = F.replace(piece, F.lit(e), F.lit(c))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, first, role, text): the final messages of an event log.

    ``log`` has conv_id, message, seq (any types that can be ordered), kind, role and text. ``delta``
    appends its text to its message, ``edit`` replaces the message by its text, ``regenerate`` empties
    it, and what follows builds it anew. Events of different messages may be mixed. The role is that of
    the first event that names one. ``first`` is the least seq of the message. Nulls: a null text is
    empty, a null role empty, null ids are ids like others. Events of equal seq are taken by kind, role and text.

    The log is shuffled once, by conversation; messages are folded on that partitioning.
    """
    parts = only(log, "conv_id", "message", "seq", "kind", "role", "text").repartition("conv_id")
    events = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    m = parts.groupBy("conv_id", "message").agg(events.alias("events"))
    replaced = F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))), F.lit(0))
    left = F.filter(F.slice("events", replaced + 1, F.size("events")), lambda e: e["kind"] != "regenerate")
    text = F.array_join(F.transform(left, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    role = F.coalesce(F.get(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    return m.select("conv_id", F.get("events", F.lit(0))["seq"].alias("first"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, segments): the formatted conversation as pieces in order, each with its loss flag.

    The pieces joined are the formatted text (:func:`formatted`); those with ``loss`` are the escaped
    texts of ``trained`` turns, and nothing else is. A conversation is one value, as its reader
    wants it, so Spark's limit of 2 GB a value holds for it. Messages of equal ``first`` are ordered by
    role and text.
    """
    role, text = escape(F.col("role"), "#<:"), escape(F.col("text"))
    head = F.concat(F.lit(HEAD), role, F.lit(COLON))
    piece = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    pieces = F.when(F.col("role") == trained, F.array(piece(head, False), piece(text, True), piece(F.lit(TAIL), False))).otherwise(F.array(piece(F.concat(head, text, F.lit(TAIL)), False)))
    turn = F.struct("first", "role", pieces.alias("pieces"))
    m = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return m.select("conv_id", F.flatten(F.transform("turns", lambda t: t["pieces"])).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.filter(F.split(text, TAIL), lambda b: b != "")
    part = lambda b, k: F.regexp_extract(b, f"(?s)^{HEAD}([^:]*){COLON}(.*)$", k)
    return F.transform(blocks, lambda b: F.struct(unescape(part(b, 1)).alias("role"), unescape(part(b, 2)).alias("text")))


def masked_text(segments: Column) -> Column:
    """What is under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversation_log(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """An event log that ends in the rows of ``conversations``: texts streamed in deltas, some after a rejected draft, some edited at the end.

    A row is a message of its own, equal rows too. Rows are ordered by turn, nulls first, rows of one
    turn by a hash of role and text. A null text is empty, a null role too.
    """
    c = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", *[F.coalesce(n, F.lit("")).alias(n) for n in ("role", "text")], F.monotonically_increasing_id().alias("message"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    whole = F.col("text")
    pieces = F.when(whole == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{delta}}}"), F.lit(0)))
    deltas = F.transform(pieces, lambda p: event("delta", p))
    draft, anew = event("delta", F.lit("I would rather ")), event("regenerate", F.lit(None).cast("string"))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))
    events = F.when(kind == 1, F.concat(F.array(draft, anew), deltas)).when(kind == 2, F.array(draft, event("edit", whole))).otherwise(deltas)
    log = c.select("conv_id", "message", "role", "turn", F.xxhash64("role", "text").alias("tie"), F.posexplode(events).alias("k", "e"))
    return log.select("conv_id", "message", F.struct("turn", "tie", "message", "k").alias("seq"), "e.kind", "role", "e.text")
