"""Literal phrase matching as generated regular expressions and column expressions.

A query is trimmed; a run of white space in it matches any run of white space in the text; every
other character matches itself, or, ignoring case, every character whose lower-case form begins with
the query character's. Matches are leftmost, do not overlap and stop at a limit per text.
"""

from __future__ import annotations

import functools
import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.model import CONTEXT_DEFAULT, MAX_MATCHES_PER_FILE

# The code points that count as white space.
WHITESPACE = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_SPACE_CHARS = "".join(map(chr, WHITESPACE))
SPACE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in WHITESPACE) + "]"
SPACE_RUN = SPACE_CLASS + "+"


@functools.cache
def _by_lower() -> dict[str, list[str]]:
    """Characters whose lower-case form differs from themselves, by that form's first character."""
    out: dict[str, list[str]] = {}
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if low != chr(c):
                out.setdefault(low[0], []).append(chr(c))
    return out


def folded_class(char: str) -> list[str]:
    """Every text character that matches ``char`` when case is ignored."""
    low = char.lower()
    rest = [c for c in _by_lower().get(low[0], []) if c.lower().startswith(low)]
    return sorted({*rest, *([low] if len(low) == 1 else [])})


def trimmed(query: str) -> str:
    return query.strip(_SPACE_CHARS)


def compile_query(query: str, ignore_case: bool = False) -> str | None:
    """The pattern for ``query``, valid for Java and RE2 alike; None if the query is blank."""
    out = []
    for part in re.split(f"([{re.escape(_SPACE_CHARS)}]+)", trimmed(query)):
        if part and part[0] in _SPACE_CHARS:
            out.append(SPACE_RUN)
        else:
            for c in part:
                chars = folded_class(c) if ignore_case else [c]
                out.append("[" + "".join(f"\\x{{{ord(x):X}}}" for x in chars) + "]")
    return "".join(out) or None


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def all_matches(text: Column, pattern: str | None, limit: int | None = MAX_MATCHES_PER_FILE) -> Column:
    """The matched strings; an empty array for a blank query or a null text."""
    if pattern is None:
        return _none("string")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return found if limit is None else F.slice(found, 1, limit)


def match_count(text: Column, pattern: str | None, limit: int | None = MAX_MATCHES_PER_FILE) -> Column:
    if pattern is None:
        return F.lit(0).cast("long")
    n = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    return n if limit is None else F.least(n, F.lit(limit).cast("long"))


def match_spans(text: Column, pattern: str | None, limit: int | None = MAX_MATCHES_PER_FILE) -> Column:
    """array<struct<start, end>>: byte offsets in the UTF-8 form of the text."""
    if pattern is None:
        return _none("struct<start:bigint,end:bigint>")
    found = all_matches(text, pattern, limit)
    gaps = F.split(F.coalesce(text, F.lit("")), pattern, -1)
    # what lies beyond the last match is a gap without one; cutting the gaps to size would search the text again
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(F.octet_length(g).cast("long").alias("g"), F.octet_length(m).cast("long").alias("m")))
    start = F.struct(F.lit(0).cast("long").alias("at"), _none("struct<start:bigint,end:bigint>").alias("out"))
    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        longer = F.struct((begin + s["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + s["m"]).alias("end")))).alias("out"))
        return F.when(s["m"].isNull(), acc).otherwise(longer)

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _inside_char(raw: Column, at: Column) -> Column:
    """Whether the byte at this offset continues a character."""
    return F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))).rlike("^[89AB]")


def _to_boundary(raw: Column, at: Column, size: Column, step: int) -> Column:
    """The nearest character boundary in the direction of ``step``; a character has four bytes at most."""
    out = at + 3 * step
    for k in (2, 1, 0):
        here = at + k * step
        out = F.when((here <= 0) | (here >= size) | ~_inside_char(raw, here), here).otherwise(out)
    return F.least(F.greatest(out, F.lit(0).cast("long")), size)


def snippets(text: Column, pattern: str | None, context_size: int = CONTEXT_DEFAULT, limit: int | None = MAX_MATCHES_PER_FILE) -> Column:
    """array<string>: each match with ``context_size`` bytes of text on both sides, widened to whole characters.

    White space runs become one space; an ellipsis marks a side at which text was left out.
    """
    if pattern is None:
        return _none("string")
    text = F.coalesce(text, F.lit(""))

    def one(raw: Column, size: Column, span: Column) -> Column:
        a = _to_boundary(raw, F.greatest(span["start"] - context_size, F.lit(0).cast("long")), size, -1)
        z = _to_boundary(raw, F.least(span["end"] + context_size, size), size, 1)
        body = F.decode(F.substring(raw, (a + 1).cast("int"), (z - a).cast("int")), "UTF-8")
        return F.concat(F.when(a > 0, "… ").otherwise(""), F.regexp_replace(body, SPACE_RUN, " "), F.when(z < size, " …").otherwise(""))

    # bound through a one-element array: the bytes are made once and not for every match
    whole = F.array(F.struct(F.encode(text, "UTF-8").alias("raw"), F.octet_length(text).cast("long").alias("size"), match_spans(text, pattern, limit).alias("spans")))
    return F.transform(whole, lambda w: F.transform(w["spans"], lambda span: one(w["raw"], w["size"], span)))[0]
