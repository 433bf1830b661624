"""Personal data found from anchors: one automaton pass, then small parsers around each hit."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from triagelake.llm.common import map_batches, only, prepared, texts

#: order of kinds at equal starts; the first four are the base kinds
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
# fixed values: cues that precede an address or identifier
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")
ACCOUNT_MIN, ACCOUNT_MAX = 8, 34
SECRET_MIN = 8
#: fixed values: words that may stand between an account cue and its number
_JOINED = re.compile(r"(?:[ \t:=#\"']{0,5}\b(?:numbers?|no|nr|num|numero|nummer|is|ist|es|est)\b\.?){0,2}[ \t:=#\"']{0,5}")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL = _ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")
_KEY = _ALNUM | frozenset("_-./+")


def automaton() -> ahocorasick.Automaton:
    """At-signs, plus signs, digit starts, schemes and cues; matching is on a lower-cased copy."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for s in ACCOUNT_CUES:
        a.add_word(s, ("account", len(s)))
    for s in SECRET_CUES:
        a.add_word(s, ("secret", len(s)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at`` that starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, at: int) -> tuple[int, bool] | None:
    """(end, valid) of four dotted numbers that start at the digit ``at``."""
    end = _run(text, at, _DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4:
        if end >= len(text) or text[end] != ".":
            return None
        stop = _run(text, end + 1, _DIGITS)
        if stop == end + 1:
            return None
        parts.append(text[end + 1 : stop])
        end = stop
    return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def digits_at(text: str, at: int) -> int:
    """End of digits that may have one space or hyphen between them."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    """End of an international number whose plus sign is at ``at``; None if its form is wrong."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in _DIGITS else None


def _value_start(text: str, at: int) -> int:
    """Where the identifier after a cue begins: blanks, one of ``:=#`` and quotes may stand between."""
    end = min(len(text), at + 6)
    while at < end and text[at] in " \t:=#\"'":
        at += 1
    return at


def iban_valid(code: str) -> bool:
    """Remainder 1 modulo 97, the first four characters moved to the end, letters as 10 to 35."""
    return code.isascii() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _account(text: str, low: str, at: int, cue: str) -> tuple[int, int] | None:
    """Letters and digits after an account cue; an IBAN, in either case, also in groups parted by one space.

    What looks like an IBAN after its own cue must have the right check digits. Joining words (number, no, is)
    may stand between.
    """
    start = _JOINED.match(low, at).end()
    end = start
    while end < len(text) and end - start < ACCOUNT_MAX and text[end] in _ALNUM:
        end += 1
    head = text[start : start + 4]
    if len(head) == 4 and head[:2].isalpha() and head[2:].isdigit() and head.isascii():
        stop, best = end, None
        while True:
            code = text[start:stop].replace(" ", "")
            if 15 <= len(code) <= ACCOUNT_MAX and iban_valid(code):
                best = stop
            if stop + 1 >= len(text) or text[stop] != " " or text[stop + 1] not in _ALNUM or len(code) > ACCOUNT_MAX:
                break
            stop += 1
            group = stop
            while stop < len(text) and stop - group <= ACCOUNT_MAX and text[stop] in _ALNUM:
                stop += 1
        if best:
            return start, best
        if cue == "iban":
            return None
    size = end - start
    return (start, end) if ACCOUNT_MIN <= size <= ACCOUNT_MAX and 2 * sum(map(str.isdigit, text[start:end])) >= size else None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All (start, end, kind), code points with end exclusive, by start and then kind."""
    # lower-casing that changes the length would shift positions, so only A-Z is lowered then
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    floor = dict.fromkeys(KINDS, 0)
    found = []

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        floor[kind] = end
        if valid:
            found.append((start, end, kind))

    barren = 0  # before this ends a run of key characters without a digit that was looked at
    in_run = -1  # digits before this are part of a run that was looked at
    for last, (kind, size) in anchors.iter(low):
        at = last - size + 1
        if kind == "email":
            got = email_at(text, at, floor["email"])
            if got:
                take("email", *got)
        elif kind == "phone":
            if at >= floor["phone"]:
                end = phone_at(text, at)
                if end:
                    take("phone", at, end, 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15)
        elif kind == "digit":
            if at >= floor["card"]:
                end = digits_at(text, at)
                if end > at + 1:
                    plain = text[at:end].replace(" ", "").replace("-", "")
                    take("card", at, end, 12 <= len(plain) <= 19 and luhn(plain))
            if at >= floor["ip"] and at > in_run:
                in_run = _run(text, at, _DIGITS) - 1
                got = ip_at(text, at)
                if got:
                    take("ip", at, *got)
        elif kind == "url":
            if at < floor["url"]:
                continue
            end = _run(text, last + 1, _URL)
            while end > last + 1 and text[end - 1] in ".,;:!?'()":
                end -= 1
            if end > last + 1:
                take("url", at, end)
        else:
            # a cue is a word of its own
            if (at > 0 and low[at - 1].isalnum()) or (last + 1 < len(low) and low[last + 1].isalnum()):
                continue
            if kind == "account":
                got = _account(text, low, last + 1, low[at : last + 1])
                if got and got[0] >= floor[kind]:
                    take(kind, *got)
                continue
            start = _value_start(text, last + 1)
            if start < floor[kind] or start < barren:
                continue
            end = _run(text, start, _KEY)
            if not any(c in _DIGITS for c in text[start:end]):
                barren = end
            elif end - start >= SECRET_MIN:
                take(kind, start, end)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]]))


def written(spans: Iterator[tuple[int, int, str]] | list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first is named."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> and the redacted text, one row per row.

    A null text is empty and has no spans. Positions are code points of the whole text.
    """
    prepared(docs.sparkSession)

    def scan(b: pa.RecordBatch) -> dict:
        anchors = automaton()
        body = texts(b)
        spans = [find_spans(t, anchors) for t in body]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": b.column("doc_id"), "spans": pa.array([[{"kind": k, "start": a, "end": e} for a, e, k in s] for s in spans], kind), "redacted": pa.array([redacted(t, s) for t, s in zip(body, spans, strict=True)], pa.string())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(only(docs, "doc_id", "text"), scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    """SHA-256 over the base spans as written."""
    return hashlib.sha256(written(s for s in spans if s[2] in KINDS[:4]).encode()).hexdigest()
