"""Chunks by budget: tokens of an index mode with the best boundary near the target, and CSV rows in groups that repeat the header."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.chunk import MAX_CHUNK
from tarn.session import ship_package


@dataclass(frozen=True)
class Budget:
    """Tokens that a chunk should have, may have, and shares with the one before it."""

    target: int
    most: int
    overlap: int


# The budgets of each index mode.
MODES = {"space_saving": Budget(192, 384, 32), "balanced": Budget(384, 768, 64), "high_accuracy": Budget(512, 1024, 96)}
#: Runs of letters and digits, as the keyword index has them.
TOKEN = re.compile(r"[^\W_]+")
#: Rows of one Arrow batch on the way out.
ROWS = 1_000


def cut(n: int, paragraphs: np.ndarray, lines: np.ndarray, own: Budget) -> list[tuple[int, int]]:
    """(first token, end) of a text's chunks; paragraphs and lines are the tokens before which one begins.

    What is left is one chunk if it has ``most`` tokens or fewer. Else the chunk ends at the last paragraph in the second half of the target, or line, or at the target; the next one begins
    ``overlap`` tokens before.
    """
    out, start = [], 0
    while n - start > own.most:
        low, high = start + own.target // 2, start + own.target
        end = high
        for places in (paragraphs, lines):
            i = int(np.searchsorted(places, high, side="right")) - 1
            if i >= 0 and places[i] > low:
                end = int(places[i])
                break
        out.append((start, end))
        start = end - own.overlap
    if n - start > 0 or not out:
        out.append((start, n))
    return out


def places_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each token, tokens before which a paragraph begins, tokens before which a line begins)."""
    starts = np.array([m.start() for m in TOKEN.finditer(text)], dtype=np.int64)
    breaks = np.array([i for i, c in enumerate(text) if c == "\n"] if "\n" in text else [], dtype=np.int64)
    lines = np.unique(np.searchsorted(starts, breaks, side="right")) if len(breaks) else breaks
    blank = np.array([m.start() for m in re.finditer(r"\n[ \t]*\n", text)], dtype=np.int64)
    paragraphs = np.unique(np.searchsorted(starts, blank, side="right")) if len(blank) else blank
    return starts, paragraphs, lines


def token_chunks(docs: DataFrame, key: str, text: str, mode: str = "balanced") -> DataFrame:
    """(key, ordinal, token_start, token_end, content): chunks of whole texts within the mode's budget; together they cover every character.

    A chunk begins at its first token, the first one at the text's start, and ends where the token behind it begins. A text without a token is one chunk of
    none; null and empty texts have no chunk.
    """
    ship_package(docs.sparkSession)
    own = MODES[mode]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                starts, paragraphs, lines = places_of(body)
                edge = lambda t, n=len(body), s=starts: 0 if t == 0 else int(s[t]) if t < len(s) else n
                rows += [(i, k, s, e, body[edge(s) : edge(e) if e < len(starts) else len(body)]) for k, (s, e) in enumerate(cut(len(starts), paragraphs, lines, own))]
                if len(rows) >= ROWS:
                    yield out(batch, rows)
                    rows = []
            if rows:
                yield out(batch, rows)

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, ordinal, start, end, content = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ordinal, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(content)], names=[key, "ordinal", "token_start", "token_end", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("t")).where("t <> ''").mapInArrow(run, f"`{key}` {kind}, ordinal int, token_start int, token_end int, content string")


def record_ends(body: bytes) -> np.ndarray:
    """Ends of a CSV text's records: its newlines outside of quotes. A quote that is not closed makes the rest one record."""
    b = np.frombuffer(body, np.uint8)
    inside = np.cumsum(b == 34) & 1
    ends = np.flatnonzero((b == 10) & (inside == 0)) + 1
    return ends if len(ends) and ends[-1] == len(b) else np.append(ends, len(b))


def csv_groups(files: DataFrame, key: str, text: str, budget: int = MAX_CHUNK) -> DataFrame:
    """(key, ordinal, chunk_kind, row_start, row_end, line_start, line_end, content): groups of a CSV text's rows, each under its header.

    Rows are numbered from 1 behind the header, lines from 1. A group has as many rows as fit ``budget`` bytes with the header, and one at least. A text whose
    rows fit is one chunk, and so is one of a header alone (rows 0 to 0). Newlines in quoted fields part nothing. Null and empty texts have no chunk.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py().encode()
                ends = record_ends(body)
                before = np.cumsum(np.frombuffer(body, np.uint8) == 10)
                line = lambda at, c=before: int(c[at - 1]) + 1 if at else 1
                head, n, first = int(ends[0]), len(ends) - 1, 0
                title = body[:head].rstrip(b"\r\n")
                while first < n or n == 0:
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + budget - head, side="right")) - 1) if n else 0
                    at, stop = int(ends[first]), int(ends[last])
                    own = body[at:stop].rstrip(b"\r\n")
                    rows.append((i, len(rows), first + 1 if n else 0, last, line(at) if n else 1, line(stop - 1), (title + b"\n" + own if n else title).decode(errors="replace")))
                    first = last
                    if not n:
                        break
            if rows:
                at, _, start, end, top, bottom, content = zip(*rows)
                fresh = np.flatnonzero(np.diff(at, prepend=-1))
                ordinal = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
                ints = [pa.array(v, pa.int32()) for v in (ordinal, start, end, top, bottom)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ints[0], pa.repeat("table", len(at)), *ints[1:], pa.array(content)], names=[key, "ordinal", "chunk_kind", "row_start", "row_end", "line_start", "line_end", "content"])

    kind = files.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ordinal int, chunk_kind string, row_start int, row_end int, line_start int, line_end int, content string"
    return files.select(key, F.col(text).cast("string").alias("t")).where("t <> ''").mapInArrow(run, schema)
