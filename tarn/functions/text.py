"""Text functions as column expressions: normalization, tokens, trigrams, escaping, paths."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
CJK = "[\\x{1100}-\\x{11FF}\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"


def _fold_table() -> tuple[str, str]:
    """Latin letters with a diacritic and the letters without."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_table()
WIDE = "".join(chr(c) for r in ((0xFF21, 0xFF3B), (0xFF41, 0xFF5B), (0xFF10, 0xFF1A)) for c in range(*r))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)


def normalize(text: Column) -> Column:
    """norm-v1: no byte order mark, newlines only, no other control characters but tabs, no white space at line ends."""
    out = F.regexp_replace(text, "^\\x{FEFF}", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, r"[\p{Cc}&&[^\n\t]]", "")
    return F.regexp_replace(out, r"(?md)[\p{IsWhite_Space}&&[^\n]]+$", "")


def fold(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII is not looked up character by character."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(F.lower(text), ACCENTED, PLAIN)).otherwise(F.lower(text))


def upper_one(c: str) -> str:
    """A character's simple upper case: one character, where the full one may be several (ß, ligatures)."""
    if len(up := c.upper()) == 1 or len(up := c.title()) == 1:
        return up
    return "\u1e9e" if c == "ß" else c


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), 0)


def trigrams(text: Column) -> Column:
    """All runs of three characters of the lower-cased text; shorter texts have none."""
    # three shifted copies are zipped: what a lambda refers to from outside would be computed again for each place
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), 0)
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    return F.zip_with(pairs, F.slice(chars, 3, n), lambda a, b: F.concat(a, b))


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def normalize_query(query: Column) -> Column:
    """Full-width letters and digits as ASCII, trimmed; case and punctuation stay."""
    return F.regexp_replace(F.translate(query, WIDE, NARROW), r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def match_expression(query: Column) -> Column:
    """Terms between white space as quoted phrases, quotes doubled; null if there are none."""
    terms = F.filter(F.split(query, r"[\p{IsWhite_Space}]+"), lambda t: t != "")
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " "))


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def snippet(text: Column, first: Column, last: Column, lines: int = 8, chars: int = 400) -> Column:
    """Lines first to last (from 1) of a text, cut to ``lines`` and ``chars``; null without a line."""
    n = F.least(last - first + 1, F.lit(lines))
    parts = F.split(text, "\n")
    return F.when((first >= 1) & (first <= F.size(parts)) & (n >= 1), F.left(F.array_join(F.slice(parts, first.cast("int"), n.cast("int")), "\n"), F.lit(chars)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension; null for names without one and for dot files."""
    ext = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def short_path(path: Column) -> Column:
    """The last two components behind an ellipsis if there are more; the root counts as one."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts) + F.when(path.startswith("/"), 1).otherwise(0)
    return F.when(n > 2, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -2, 2), "/"))).otherwise(path)


def title(heading_path: Column, path: Column) -> Column:
    return F.coalesce(heading_path, file_name(path))


def badges(keyword_rank: Column, vector_rank: Column) -> Column:
    own = F.array(F.when(keyword_rank.isNotNull(), F.lit("Keyword")), F.when(vector_rank.isNotNull(), F.lit("Semantic")))
    return F.filter(own, lambda b: b.isNotNull())


def redact(text: Column, home: str) -> Column:
    """Home folder, absolute paths and query strings taken out of diagnostics."""
    out = F.replace(text, F.lit(home.rstrip("/")), F.lit("<home>"))
    out = F.regexp_replace(out, r"\?[^\s\"']+", "?<redacted query>")
    return F.regexp_replace(out, r"(?<![\w:/.<>])/(?:[^\s/\"']+/)+([^\s/\"']+)", "<folder>/$1")


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """An id that is the same in every run, unlike a random one."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("#", *parts), 256))
