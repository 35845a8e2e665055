"""Files to segments. Sequential formats run in Arrow-batched functions, a row for each file; errors become values."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import extension, normalize
from tarn.operators import pdf
from tarn.session import by_row, ship_package
from tarn.sources.schema import EXTRACT


# The limits.
@dataclass(frozen=True)
class Limits:
    """Bounds of one extraction."""

    file_bytes: int = 64 << 20
    chars: int = 5_000_000
    segments: int = 20_000
    pages: int = 1_000
    docx_xml_bytes: int = 32 << 20
    zip_bytes: int = 64 << 20
    html_bytes: int = 32 << 20


# The extractors' order and extensions.
TEXT_EXTENSIONS = ("txt", "log", "csv", "rs", "py", "js", "ts", "jsx", "tsx", "java", "c", "h", "cpp", "hpp", "go", "rb", "php", "sh", "bash", "sql", "toml", "yaml", "yml", "json", "xml", "css", "html", "htm")
ROUTES = (("markdown", ("md", "markdown")), ("docx", ("docx",)), ("html", ("html", "htm")), ("text", TEXT_EXTENSIONS), ("pdf", ("pdf",)))
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def route(path: Column) -> Column:
    """Name of the first extractor that takes the path's extension, or null."""
    out, ext = None, extension(path)
    for name, exts in ROUTES:
        out = (F if out is None else out).when(ext.isin(*exts), name)
    return out


def clean(text: str) -> str:
    """norm-v1 for the sequential extractors; the column form is functions.text.normalize."""
    text = CONTROL.sub("", text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(line.rstrip() for line in text.split("\n"))


def _segment(kind: str, text: str, start: int, end: int, place: str = "lines", heading: str | None = None, exact: bool = True) -> dict:
    return {"kind": kind, "text": text, "line_start": start, "line_end": end, "location_kind": place, "heading_path": heading, "location_quality": "exact" if exact else "approximate"}


def _lines(text: str) -> list[str]:
    return text[:-1].split("\n") if text.endswith("\n") else text.split("\n") if text else []


def paragraphs(text: str) -> list[dict]:
    """Runs of lines that are not blank, with their places from 1."""
    out, start, own = [], 0, []
    for no, line in enumerate([*_lines(text), ""], 1):
        if line.strip():
            start = start or no
            own.append(line)
        elif own:
            out.append(_segment("paragraph", "\n".join(own), start, no - 1))
            start, own = 0, []
    return out


HEADING = re.compile(r"\s*(#{1,6}) (.*)", re.S)
FENCE = re.compile(r"\s*(`{3,}|~{3,})")


def markdown(text: str) -> list[dict]:
    """Headings with the path above them, fenced code, and paragraphs in between."""
    lines, out, trail, own, i = _lines(text), [], [], [], 0

    def path() -> str | None:
        return " > ".join(t for _, t in trail) or None

    def flush(end: int) -> None:
        if own:
            out.append(_segment("paragraph", "\n".join(own), end - len(own) + 1, end, heading=path()))
            own.clear()

    while i < len(lines):
        line, no = lines[i], i + 1
        i += 1
        head = HEADING.fullmatch(line)
        name = head[2].strip().rstrip("#").rstrip() if head else ""
        if name:
            flush(no - 1)
            trail = [(n, t) for n, t in trail if n < len(head[1])] + [(len(head[1]), name)]
            out.append(_segment("heading", name, no, no, heading=path()))
        elif fence := FENCE.match(line):
            flush(no - 1)
            mark, body = fence[1][0], []
            while i < len(lines) and not ((f := FENCE.match(lines[i])) and f[1][0] == mark):
                body.append(lines[i])
                i += 1
            i += 1
            out.append(_segment("code_block", "\n".join(body), no, min(i, len(lines)), heading=path()))
        elif line.strip():
            own.append(line)
        else:
            flush(no - 1)
    flush(len(lines))
    return out


BLOCKS = frozenset(("p", "div", "li", "td", "th", "article", "section", "blockquote"))
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PIECE = re.compile(r"<([^>]*)(?:>|$)|([^<]+)")


def html_blocks(html: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, heading path) of a page's blocks. Entities stay as they are; ``br/`` is no line break.

    A tag runs to the next ``>``, and a ``<`` within it starts it anew. Blocks start at opening tags alone.
    The heading path is the trail of all headings so far, whatever their level.
    """
    out: list[tuple[str, str, str | None]] = []
    own: list[str] = []
    kind, trail, skip = "paragraph", [], 0

    def close(as_kind: str) -> str:
        text = "".join(own).strip()
        own.clear()
        if text:
            out.append((as_kind, text, " > ".join(trail) or None))
        return text

    for m in PIECE.finditer(html):
        if m[2] is not None:
            if not skip:
                own.append(m[2])
            continue
        if not m[0].endswith(">"):
            continue
        tag = m[1].rpartition("<")[2].strip().lower()
        closing = tag.startswith("/")
        name = tag[1:].strip() if closing else (tag.split() or [""])[0]
        if name in ("script", "style"):
            skip = max(0, skip - 1) if closing else skip + 1
        elif name in HEADS and not closing:
            close(kind)
            kind = "heading"
        elif name in HEADS:
            title = "".join(own).strip()
            if title:
                trail = [t for t in trail if t != title] + [title]
            close("heading")
            kind = "paragraph"
        elif name in BLOCKS and not closing:
            close(kind)
            kind = "paragraph"
        elif name == "br":
            own.append("\n")
    close(kind)
    return out


class Failure(Exception):
    """An expected error: a category and a message."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def _decode(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        raise Failure("encoding_error", "file is not valid UTF-8") from None


def _cap(segments: list[dict], limits: Limits, warnings: list[dict]) -> list[dict]:
    if len(segments) > limits.segments:
        segments = segments[: limits.segments]
        warnings.append({"kind": "size_limit_reached", "limit_name": "max_segments"})
    total = 0
    for i, s in enumerate(segments):
        total += len(s["text"])
        if total > limits.chars:
            warnings.append({"kind": "size_limit_reached", "limit_name": "max_extracted_chars"})
            return segments[:i]
    return segments


def _docx(content: bytes, limits: Limits) -> list[dict]:
    """Paragraphs of word/document.xml: the text runs of each ``w:p``."""
    from xml.etree import ElementTree

    if len(content) > limits.zip_bytes:
        raise Failure("file_too_large", f"archive is {len(content)} bytes")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > limits.docx_xml_bytes:
                raise Failure("file_too_large", "document.xml is too large")
            tree = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Failure("malformed_document", str(e)) from None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    texts = (clean("".join(t.text or "" for t in p.iter(f"{w}t"))) for p in tree.iter(f"{w}p"))
    return [_segment("paragraph", t, i, i, "blocks", exact=False) for i, t in enumerate((t for t in texts if t.strip()), 1)]


def _pdf(content: bytes, limits: Limits, warnings: list[dict]) -> list[dict]:
    """A segment for each page with text. Pages that cannot be read, a cut at the page limit and a file without any text are warnings."""
    try:
        doc = pdf.Pdf(content, limits.file_bytes)
        pages = doc.pages()
    except pdf.Encrypted as e:
        raise Failure("encrypted_document", str(e)) from None
    except ValueError as e:
        raise Failure("parser_error", str(e)) from None
    if len(pages) > limits.pages:
        warnings.append({"kind": "size_limit_reached", "limit_name": "max_pdf_pages"})
    out, bad = [], []
    for n, page in enumerate(pages[: limits.pages], 1):
        try:
            text = clean(doc.text(page))
        except (ValueError, IndexError):
            bad.append(n)
            continue
        if text.strip():
            out.append(_segment("other", text, n, n, "pages", f"Page {n}") | {"location_quality": "page_only"})
    if bad:
        warnings.append({"kind": "some_pages_unreadable", "pages": bad})
    if pages and not out:
        warnings.append({"kind": "possibly_scanned_pdf"})
    return out


def read_error(e: OSError) -> str:
    """Category of a read that failed."""
    return "permission_denied" if isinstance(e, PermissionError) else "source_missing" if isinstance(e, FileNotFoundError) else "read_error"


def read_files(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``content`` and ``read_error``, null where the read went well; one file that fails fails no other."""

    @F.pandas_udf("content binary, read_error string")
    def run(paths: pd.Series) -> pd.DataFrame:
        import pyarrow.fs

        def one(p: str | None) -> tuple[bytes | None, str | None]:
            try:
                system, at = pyarrow.fs.FileSystem.from_uri(p if p and "://" in p else f"file://{p or ''}")
                with system.open_input_file(at) as f:
                    return f.read(), None
            except OSError as e:
                return None, read_error(e)

        return pd.DataFrame([one(p) for p in paths], columns=["content", "read_error"])

    ship_package(files.sparkSession)
    return files.withColumn("_read", run(F.col(path))).withColumn("content", F.col("_read.content")).withColumn("read_error", F.col("_read.read_error")).drop("_read")


def extract_one(name: str | None, content: bytes | None, limits: Limits = Limits()) -> dict:
    """What one file gives; an error is a value with a category, never an exception."""
    out = {"extractor_name": name, "extractor_version": "1", "segments": [], "char_count": 0, "warnings": [], "error_category": None, "message": None}
    try:
        if name is None:
            raise Failure("unsupported_type", "no extractor for this type here")
        content = content or b""
        if len(content) > (limits.html_bytes if name == "html" else limits.file_bytes):
            raise Failure("file_too_large", f"file is {len(content)} bytes")
        if name == "docx":
            segments = _docx(content, limits)
        elif name == "pdf":
            segments = _pdf(content, limits, out["warnings"])
        elif name == "html":
            blocks = [(k, clean(t), h) for k, t, h in html_blocks(_decode(content))]
            segments = [_segment(k, t, i, i, "blocks", h, False) for i, (k, t, h) in enumerate(blocks, 1) if t.strip()]
        else:
            text = clean(_decode(content))
            segments = markdown(text) if name == "markdown" else paragraphs(text)
        out["segments"] = _cap(segments, limits, out["warnings"])
        out["char_count"] = sum(len(s["text"]) for s in out["segments"])
    except Failure as e:
        out |= {"error_category": e.category, "message": str(e)}
    except Exception as e:  # one bad file must not fail the job
        out |= {"error_category": "parser_panic", "message": f"{type(e).__name__}: {e}"[:500]}
    return out


def extract(files: DataFrame, path: str = "path", content: str = "content", limits: Limits = Limits(), extractors: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """``files`` with ``extractor`` and ``extracted``; types without an extractor do not reach Python."""
    ship_package(files.sparkSession)
    own = extractors or {}

    def one(n: str | None, b: bytes | None) -> dict:
        try:
            return own[n](b) if n in own else extract_one(n, b, limits)
        except Exception as e:
            return extract_one(None, None) | {"extractor_name": n, "error_category": "parser_panic", "message": str(e)[:500]}

    run = by_row(one, EXTRACT)
    rows = files.withColumn("extractor", F.coalesce(route(F.col(path)), F.lit("none")))
    known = rows.where(F.col("extractor").isin(*[n for n, _ in ROUTES], *own))
    other = rows.where(~F.col("extractor").isin(*[n for n, _ in ROUTES], *own))
    refused = F.struct(F.col("extractor").alias("extractor_name"), F.lit("1").alias("extractor_version"), F.array().alias("segments"), F.lit(0).alias("char_count"), F.array().alias("warnings"), F.lit("unsupported_type").alias("error_category"), F.lit("no extractor for this type here").alias("message"))
    return known.withColumn("extracted", run("extractor", F.col(content).cast("binary"))).unionByName(other.withColumn("extracted", refused.cast(EXTRACT)))


def paragraph_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, line_start, line_end, text): blank lines part paragraphs; built-ins alone.

    The whole normalized text is split at its blank lines, so no window over lines is needed.
    """
    body = F.regexp_replace(normalize(F.col(text)), "\n$", "")
    # lines with their numbers; a paragraph is told by the number of blank lines above it
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"), (F.btrim(x, F.lit(" \t\u3000\u00a0")) == "").alias("blank")))
    rows = docs.select(F.col(key), F.inline(lines))
    above = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("island", F.sum(F.col("blank").cast("int")).over(above)).where(~F.col("blank"))
    out = marked.groupBy(key, "island").agg(F.min("no").alias("line_start"), F.max("no").alias("line_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n").alias("text"))
    order = Window.partitionBy(key).orderBy("line_start")
    return out.withColumn("paragraph", F.row_number().over(order)).drop("island")
