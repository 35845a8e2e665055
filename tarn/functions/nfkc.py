"""Compatibility normalization (NFKC) as a column function."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL_VOWELS, HANGUL_ENDS = range(0x1161, 0x1176), range(0x11A8, 0x11C3)
#: Stable stretches beyond Latin that are ruled out in the JVM: the longest ones. A class of all would be searched range by range at every character.
LONGEST = 6


@functools.cache
def unstable() -> str:
    """A character class that has all that may change under NFKC, by itself or beside others: characters with another form, combining marks,
    and those that a composition ends with. It is a few ranges short of stable characters, so a text without any of them is its own NFKC, and others may be."""
    ends = {*HANGUL_VOWELS, *HANGUL_ENDS}
    odd = set()
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c:
            odd.add(code)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            ends.add(int(parts[1], 16))
    edges = [-1, *sorted(odd | ends), sys.maxunicode + 1]
    gaps = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    longest = sorted((g for g in gaps if g[0] >= 0x250), key=lambda g: g[0] - g[1])[:LONGEST]
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in sorted({*(g for g in gaps if g[0] < 0x250), *longest})) + "]"


@functools.cache
def _compose():
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    compose.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compose, "string")


def nfkc(text: Column) -> Column:
    """NFKC of a text, null of null. Only texts with a character that may change leave the JVM."""
    odd = text.rlike(unstable())
    return F.when(odd, _compose()(F.when(odd, text))).otherwise(text)
