"""Segments to chunks: the document itself, then sections or packed paragraphs, long ones in overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import deterministic_id
from tarn.session import by_row, ship_package
from tarn.sources.schema import CHUNK

#: Bytes up to which a section or paragraph is one chunk, and code points of a window and its overlap.
MAX_CHUNK, OVERLAP = 1200, 120


def _chunk(kind: str, text: str, place: str, start: int, end: int, heading: str | None = None, title: str | None = None, quality: str = "exact", parent: int | None = 0) -> dict:
    return {"chunk_kind": kind, "chunk_ordinal": 0, "heading_path": heading, "title": title, "normalized_text": text, "location_kind": place, "line_start": start, "line_end": end, "location_quality": quality, "parent_ordinal": parent}


def windows(text: str, start: int, end: int, place: str, heading: str | None = None) -> list[dict]:
    """Windows of ``MAX_CHUNK`` code points that overlap; lines are told by the share of the text."""
    out, n, span = [], len(text), max(1, end - start)
    for at in range(0, max(1, n - OVERLAP), MAX_CHUNK - OVERLAP):
        stop = min(at + MAX_CHUNK, n)
        out.append(_chunk("fallback", text[at:stop].strip(), place, start + int(span * (at / n)), start + int(span * (stop / n)), heading, quality="approximate"))
        if stop == n:
            break
    return out


def _fit(text: str, kind: str, start: int, end: int, place: str, heading: str | None, title: str | None) -> list[dict]:
    if len(text.encode()) > MAX_CHUNK:
        return windows(text, start, end, place, heading)
    return [_chunk(kind, text, place, start, end, heading, title)]


def sections(segments: list[dict]) -> list[dict]:
    """A section for each heading and one for what comes before the first; blank ones go."""
    groups: list[tuple[str, str, list[dict]]] = []
    trail: list[str] = []
    for s in segments:
        if s["kind"] == "heading":
            level = (s["heading_path"] or "").count(">") + 1
            title = s["text"].strip()
            trail = [*trail[: level - 1], title]
            groups.append((title, " > ".join(trail), [s]))
        elif groups:
            groups[-1][2].append(s)
        else:
            groups.append(("", "", [s]))
    out = []
    for title, path, own in groups:
        text = "\n".join(s["text"] for s in own)
        if text.strip():
            out += _fit(text, "section", own[0]["line_start"], own[-1]["line_end"], own[0]["location_kind"], path, title)
    return out


def packed(segments: list[dict]) -> list[dict]:
    """Paragraphs together until they have ``MAX_CHUNK`` bytes."""
    out, buffer, start, end = [], "", 0, 0
    place = segments[0]["location_kind"] if segments else "unknown"

    def flush() -> None:
        text = buffer.strip()
        if text:
            out.extend(_fit(text, "paragraph", start, end, place, None, None))

    for s in segments:
        start = start or s["line_start"]
        end = s["line_end"]
        buffer += s["text"] + "\n"
        if len(buffer.encode()) >= MAX_CHUNK:
            flush()
            buffer, start = "", end + 1
    flush()
    return out


def chunk_one(segments: list[dict] | None, name: str | None) -> list[dict]:
    """All chunks of a file in order; the first is the document and the parent of the others."""
    if segments is None or not len(segments):
        return [_chunk("document", "", "unknown", 1, 1, title=name, quality="unknown", parent=None)]
    heads = [s["text"].strip() for s in segments if s["kind"] == "heading"]
    whole = _chunk("document", "\n".join(s["text"] for s in segments), segments[0]["location_kind"], segments[0]["line_start"], segments[-1]["line_end"], heads[0] if heads else None, name, parent=None)
    out = [whole, *(sections(segments) if heads else packed(segments))]
    return [c | {"chunk_ordinal": i} for i, c in enumerate(out)]


def chunk_files(files: DataFrame, file_id: str, segments: Column, name: Column) -> DataFrame:
    """(file_id, chunk_id, chunk columns, content_hash, char_count): a row for each chunk of each file."""
    ship_package(files.sparkSession)

    run = by_row(chunk_one, f"array<{CHUNK}>")
    rows = files.select(F.col(file_id).alias("file_id"), F.inline(run(segments, name)))
    return rows.select(
        "file_id",
        deterministic_id("chunk_", F.col("file_id").cast("string"), F.col("chunk_ordinal").cast("string")).alias("chunk_id"),
        *[c for c in rows.columns if c != "file_id"],
        F.sha2("normalized_text", 256).alias("content_hash"),
        F.length("normalized_text").cast("bigint").alias("char_count"),
    )


def window_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, window): the overlapping windows of whole texts with built-ins alone; empty texts have none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - OVERLAP - 1, F.lit(0)), F.lit(MAX_CHUNK - OVERLAP))
    rows = docs.where(n > 0).select(F.col(key), F.col(text).alias("_t"), F.explode(starts).alias("start"))
    return rows.select(key, "start", F.substr("_t", F.col("start") + 1, F.lit(MAX_CHUNK)).alias("window"))
