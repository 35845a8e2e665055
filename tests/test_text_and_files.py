import io
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.functions.vectors import from_blob, hashed_chars, quantize, to_blob
from tarn.operators import chunk, extract, keyword, pdf
from tarn.sources import files as fs
from tarn.sources import schema
from tarn.sources.report import synthetic_corpus, to_markdown
from tarn.sources.store import Store


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("﻿a \r\nb\t\rc\x00\x07", "a\nb\nc"), ("", ""), (None, None), ("x 　\n\ty  ", "x\n\ty"),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, tx.normalize) == want
    if raw is not None:
        assert extract.clean(raw) == want and extract.clean(want) == want


def test_tokens_and_trigrams(spark):
    assert one(spark, "Café ERR-4042", tx.tokens) == ["cafe", "err", "4042"]
    assert one(spark, "認証トークン", tx.trigrams) == ["認証ト", "証トー", "トーク", "ークン"]
    assert one(spark, "ab", tx.trigrams) == [] and one(spark, "", tx.trigrams) == []


def test_paths(spark):
    assert one(spark, "/home/u/docs/a.md", tx.short_path) == "…/docs/a.md"
    assert one(spark, "docs/a.md", tx.short_path) == "docs/a.md"
    assert one(spark, ".bashrc", tx.extension) is None and one(spark, "a.TAR.Gz", tx.extension) == "gz"
    assert one(spark, "saw /home/me/x and /srv/a/b.txt?k=v&w", lambda c: tx.redact(c, "/home/me")).count("<") == 3


def test_markdown():
    text = "intro\n\n# A\ntext\nmore\n## B ##\n```py\n# no\n```\n~~~\nopen\n# C\nend"
    got = [(s["kind"], s["text"], s["line_start"], s["line_end"], s["heading_path"]) for s in extract.markdown(text)]
    assert got == [
        ("paragraph", "intro", 1, 1, None), ("heading", "A", 3, 3, "A"), ("paragraph", "text\nmore", 4, 5, "A"), ("heading", "B", 6, 6, "A > B"),
        ("code_block", "# no", 7, 9, "A > B"), ("code_block", "open\n# C\nend", 10, 13, "A > B"),
    ]


def test_html():
    html = '<h1>T</h1>x<p>a &amp; b<br/>c<br>d</p>e<script>var t="</p>";</script><h2>U</h2><div>f<div>g'
    assert extract.html_blocks(html) == [
        ("heading", "T", "T"), ("paragraph", "x", "T"), ("paragraph", 'a &amp; bc\nde', "T"), ("heading", "U", "T > U"), ("paragraph", "f", "T > U"), ("paragraph", "g", "T > U"),
    ]


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_extract_isolation_and_limits(spark):
    def broken(content):
        raise RuntimeError("boom")

    rows = [("a.md", b"# H\nx"), ("b.txt", b"\xff\xfe"), ("c.docx", docx("one", "two")), ("d.docx", b"no zip"), ("e.pdf", b"%PDF"), ("f.zzz", b""), ("g.log", b"x"), ("h.html", b"<p>a<p>b<p>c"), ("i.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    small = extract.Limits(segments=2)
    got = {r.path: r.extracted for r in extract.extract(df, limits=small, extractors={"markdown": broken}).collect()}
    cats = {k: v.error_category for k, v in got.items()}
    assert cats == {"a.md": "parser_panic", "b.txt": "encoding_error", "c.docx": None, "d.docx": "malformed_document", "e.pdf": "parser_error", "f.zzz": "unsupported_type", "g.log": None, "h.html": None, "i.txt": None}
    assert [s.text for s in got["c.docx"].segments] == ["one", "two"]
    assert len(got["h.html"].segments) == 2 and got["h.html"].warnings[0].limit_name == "max_segments"
    assert extract.extract_one("text", b"x" * 20, extract.Limits(file_bytes=10))["error_category"] == "file_too_large"


def test_chunks():
    assert chunk.chunk_one([], "n")[0]["location_quality"] == "unknown"
    md = extract.markdown("pre\n\n# A\n" + "wort " * 300 + "\n## B\nshort")
    got = chunk.chunk_one(md, "n")
    assert [c["chunk_kind"] for c in got] == ["document", "section", "fallback", "fallback", "section"]
    assert got[0]["heading_path"] == "A" and got[-1]["heading_path"] == "A > B" and got[1]["heading_path"] == ""
    assert [c["chunk_ordinal"] for c in got] == list(range(5))
    # limits are bytes for packing and code points for windows
    long = "é" * 700
    packed = chunk.chunk_one(extract.paragraphs(long), "n")
    assert [c["chunk_kind"] for c in packed] == ["document", "fallback"] and packed[1]["normalized_text"] == long
    text = "".join(chr(97 + i % 26) for i in range(5000))
    parts = [w["normalized_text"] for w in chunk.windows(text, 1, 10, "lines")]
    assert parts[0] + "".join(p[120:] for p in parts[1:]) == text


def test_bm25_against_sqlite(spark):
    docs = ["refresh tokens should expire before ERR-4042 occurs", "unrelated text about gardening", "tokens tokens tokens", "Café tokens expire", "", "a b c d e f g", "the ERR 4042 code"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", [(i + 1, f"t{i}", d) for i, d in enumerate(docs)])
    df = spark.createDataFrame([(i + 1, f"t{i}", d) for i, d in enumerate(docs)], "id long, title string, body string")
    asked = ["tokens", "tokens expire", "ERR-4042", "cafe", "| tokens", "|", "nothing", "", 'say "hi"']
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in keyword.search(df, queries, "id", {"title": F.col("title"), "body": F.col("body")}).collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    for i, q in enumerate(asked):
        match = " ".join('"' + t.replace('"', '""') + '"' for t in q.split())
        rows = con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (match,)).fetchall() if match else []
        assert sorted(got.get(i, [])) == sorted((a, round(b, 9)) for a, b in rows), q


def test_cjk_routing(spark):
    corpus = synthetic_corpus(spark, 16)
    queries = spark.createDataFrame([(0, "認証トークン"), (1, "ＥＲＲ-4042")], "query_id long, query string")
    rows = keyword.routed(corpus, queries, "name", {"text": F.col("text")}, 5).collect()
    assert {r.name for r in rows if r.query_id == 0} == {"japanese-0005.md", "japanese-0013.md"}
    assert {r.name.split("-")[0] for r in rows if r.query_id == 1} == {"auth", "japanese"}
    for q in (0, 1):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [r.score for r in own] == sorted(r.score for r in own)


def test_vector_codecs(spark):
    v = [0.5, -0.5, 0.004, 1.5]
    assert one(spark, v, quantize, "array<double>") == [64, -64, 1, 127]
    assert from_blob(to_blob(v), 4).tolist() == pytest.approx(v) and from_blob(to_blob(v), 5) is None
    assert len(one(spark, "ab", hashed_chars)) == 8


def test_scan_folder(spark, tmp_path):
    for name in ("a.md", "b.txt", "sub/c.md", ".hidden/d.md", "node_modules/e.md", "big.md"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x" * (50 if name == "big.md" else 3))
    policy = fs.ScanPolicy(include=("*.md",), max_bytes=10)
    rows = fs.scan_folder(spark, str(tmp_path), policy, "s", content=True).collect()
    assert sorted(r.display_path for r in rows) == ["a.md", "sub/c.md"] and all(len(r.content_hash) == 64 for r in rows)
    assert fs.path_state(str(tmp_path)) == "active" and fs.path_state(str(tmp_path / "no")) == "folder_not_found"


def test_scan_sees_every_name(spark, tmp_path):
    """Names with a leading dot or underscore are there as the policy wants, links are not followed, and paths behind them are refused."""
    for name in ("_index.md", ".b.md", ".h/c.md", "a.md", "_d/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    names = lambda **k: sorted(r.display_path for r in fs.scan_folder(spark, str(tmp_path), fs.ScanPolicy(hidden=k.pop("hidden", False)), **k).collect())
    assert names() == ["_d/e.md", "_index.md", "a.md"]
    assert names(hidden=True, content=True) == [".b.md", ".h/c.md", "_d/e.md", "_index.md", "a.md"] and "link.md" in names(follow_links=True)
    assert fs.validated_path(str(tmp_path / "a.md"), [str(tmp_path)]) == str(tmp_path / "a.md")
    for path, why in (("link.md", "symlink_policy_blocked"), (".b.md", "hidden_file_excluded"), ("../x", "path_outside_source")):
        with pytest.raises(fs.PathRefused, match=why):
            fs.validated_path(str(tmp_path / path), [str(tmp_path)])
    with pytest.raises(fs.PathRefused, match="file_too_large"):
        fs.validated_path(str(tmp_path / "a.md"), [str(tmp_path)], fs.ScanPolicy(max_bytes=0))


def test_pdf():
    """Compressed pages, font maps, escapes, arrays, encryption, unreadable and empty pages."""
    cmap = b"beginbfchar <01> <0041> <02> <00e9> endbfchar beginbfrange <10> <12> <0061> endbfrange"
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R 5 0 R 6 0 R] /Resources << /Font << /F1 9 0 R >> >> >> endobj",
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 7 0 R >> endobj", b"4 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 9 0 R >> >> /Contents [8 0 R 7 0 R] >> endobj",
        b"5 0 obj << /Type /Page /Contents 11 0 R >> endobj", b"6 0 obj << /Type /Page >> endobj",
        b"7 0 obj << /Length 9 >> stream\nBT (a\\(b\\)\\101) Tj 0 -12 Td [(wi) -20 (de) -300 (gap)] TJ ET\nendstream endobj",
        b"8 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT /F1 9 Tf <0102101112> Tj ET") + b"\nendstream endobj",
        b"9 0 obj << /Type /Font /ToUnicode 10 0 R >> endobj", b"10 0 obj << >> stream\n" + cmap + b"\nendstream endobj",
        b"11 0 obj << /Filter /LZWDecode >> stream\nxx\nendstream endobj",
    ]
    data = b"%PDF-1.4\n" + b"\n".join(parts)
    doc = pdf.Pdf(data)
    assert len(doc.pages()) == 4 and doc.text(doc.pages()[0]) == "a(b)A\nwide gap"
    out = extract.extract_one("pdf", data)
    assert [(x["text"].split("\n")[0], x["heading_path"]) for x in out["segments"]][0] == ("a(b)A", "Page 1") and [x["line_start"] for x in out["segments"]] == [1, 2]
    assert out["segments"][1]["text"].startswith("A\u00e9abc") or "abc" in out["segments"][1]["text"]
    assert out["warnings"] == [{"kind": "some_pages_unreadable", "pages": [3]}]
    assert extract.extract_one("pdf", data + b"trailer << /Encrypt 5 0 R >>")["error_category"] == "encrypted_document"
    assert extract.extract_one("pdf", b"no pdf")["error_category"] == "parser_error"
    assert extract.extract_one("pdf", b"%PDF-1.4\n" + b"\n".join(parts[:2] + parts[5:6]))["warnings"] == [{"kind": "possibly_scanned_pdf"}]
    cut = extract.extract_one("pdf", data, extract.Limits(pages=1))
    assert len(cut["segments"]) == 1 and cut["warnings"][0]["limit_name"] == "max_pdf_pages"


def test_read_errors():
    assert [extract.read_error(e) for e in (PermissionError(), FileNotFoundError(), IsADirectoryError())] == ["permission_denied", "source_missing", "read_error"]


def test_store_versions(spark, tmp_path):
    """A version without its mark is not there; appended parts do not write the others again; old versions go."""
    store = Store(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(str(i), "info", "k", None, None)], "event_id string, severity string, kind string, details string, created_at timestamp")
    ids = lambda: sorted(r.event_id for r in store.read("app_events").collect())
    store.append("app_events", row(1))
    store.append("app_events", row(2))
    assert ids() == ["1", "2"]
    (tmp_path / "s/app_events/v3").mkdir()
    assert ids() == ["1", "2"]
    store.replace("app_events", row(3))
    store.append("app_events", row(4))
    assert ids() == ["3", "4"]
    store.shrink("app_events")
    store.shrink("app_events")
    assert ids() == ["3", "4"] and not (tmp_path / "s/app_events/v1").exists()


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.migrate() == [1, 2, 3] and store.migrate() == []
    store.set("mode", {"a": 1})
    store.set("mode", {"a": 2})
    assert store.get("mode") == {"a": 2} and store.get("none", 5) == 5
    assert store.read("settings").count() == 1 and store.read("files").count() == 0
    assert schema.pending_migrations(store.read("schema_version")).count() == 0


def test_vocabulary(spark):
    with pytest.raises(Exception, match="bad file status"):
        one(spark, "odd", lambda c: schema.one_of(c, schema.FILE_STATUS, "file status"))
    assert "| p99 | 3 |" in to_markdown({"p99": 3}, "t")
