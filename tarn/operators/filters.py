"""Filters over results, trust states, privacy rules."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import contains_cjk, extension

# Extensions of each kind.
KINDS = {
    "documents": ("docx", "doc", "odt", "rtf"),
    "pdfs": ("pdf",),
    "notes": ("md", "markdown", "txt"),
    "code": ("rs", "py", "js", "ts", "java", "c", "h", "cpp", "hpp", "go", "rb", "sh", "toml", "yaml", "yml", "json", "sql"),
    "spreadsheets": ("csv", "xlsx", "xls", "ods"),
}
CHANGED = {"any": None, "today": "day", "this_week": "week", "this_month": "month", "this_year": "year"}
# Warnings that degrade a result.
DEGRADING = ("some_pages_unreadable", "possibly_scanned_pdf", "size_limit_reached", "unsupported_document_part", "malformed_content_recovered")


def kind(path: Column) -> Column:
    """Kind of a file by its extension, or null."""
    out, ext = None, extension(path)
    for name, exts in KINDS.items():
        out = (F if out is None else out).when(ext.isin(*exts), name)
    return out


def changed(modified: Column, within: str, now: Column) -> Column:
    """Modified since the calendar day, week, month or year of ``now`` began."""
    unit = CHANGED[within]
    return F.lit(True) if unit is None else modified >= F.date_trunc(unit, now)


def language(text: Column) -> Column:
    """ja if over half of the letters are CJK, mixed if some characters are (full-width Latin too), else en."""
    wide = F.length(F.regexp_replace(text, r"[^\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{1100}-\x{11FF}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(~contains_cjk(text), "en").when(2 * wide > letters, "ja").otherwise("mixed")


def in_folder(path: Column, folder: str, subfolders: bool = True) -> Column:
    base = folder.rstrip("/") + "/"
    below = path.startswith(base)
    return below if subfolders else below & ~F.substr(path, F.lit(len(base) + 1)).contains("/")


@dataclass(frozen=True)
class Scope:
    """Where to search: a folder, or everywhere."""

    folder: str | None = None
    subfolders: bool = True

    def within(self, folder: str) -> Scope:
        return Scope(folder)

    def cleared(self) -> Scope:
        return Scope()

    def with_subfolders(self, yes: bool) -> Scope:
        return replace(self, subfolders=yes)

    def predicate(self, path: Column) -> Column:
        return F.lit(True) if self.folder is None else in_folder(path, self.folder, self.subfolders)


@dataclass(frozen=True)
class Filter:
    """One active filter: (kind | changed | status | language | source, value)."""

    name: str
    value: str

    def predicate(self, now: Column | None = None) -> Column:
        """Over columns path, modified_at, trust_state, text, source_id."""
        if self.name == "kind":
            return extension(F.col("path")).isin(*KINDS[self.value])
        if self.name == "changed":
            return changed(F.col("modified_at"), self.value, now if now is not None else F.current_timestamp())
        if self.name == "status":
            return F.col("trust_state") == self.value
        if self.name == "language":
            return F.lit(True) if self.value == "any" else language(F.col("text")) == self.value
        return F.col("source_id") == self.value


@dataclass(frozen=True)
class ActiveFilters:
    items: tuple[Filter, ...] = ()

    def add(self, f: Filter) -> ActiveFilters:
        return self if f in self.items else ActiveFilters((*self.items, f))

    def remove(self, i: int) -> ActiveFilters:
        return ActiveFilters(self.items[:i] + self.items[i + 1 :])

    def cleared(self) -> ActiveFilters:
        return ActiveFilters()

    def apply(self, results: DataFrame, now: Column | None = None) -> DataFrame:
        return results.where(reduce(lambda a, b: a & b, (f.predicate(now) for f in self.items), F.lit(True)))


def facets(results: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n) of each column's values in one pass; values without a result don't occur."""
    spread = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in names]))
    return results.select(spread.alias("f")).where("f.value is not null").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def results_state(before: Column, after: Column) -> Column:
    return F.when(before == 0, "empty_after_search").when(after == 0, "empty_after_filtering").otherwise("ready")


def trust_state(status: Column, warnings: Column) -> Column:
    """State of a result from its file's status and its extraction's warnings (array of kinds)."""
    degraded = F.coalesce(F.exists(warnings, lambda w: w.isin(*DEGRADING)), F.lit(False))
    return (
        F.when(status == "indexed", F.when(degraded, "partly_prepared").otherwise("ready"))
        .when(status == "stale", "needs_update")
        .when(status.isin("missing", "deleted"), "file_not_found")
        .when(status == "discovered", "still_being_prepared")
        .when(status == "permission_denied", "cannot_open")
        .when(status == "failed", "partly_prepared")
        .otherwise("ready")
    )


def recovery_actions(status: Column, warnings: Column) -> Column:
    """What a user may do about a state."""
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    state = trust_state(status, warnings)
    shown = F.size(F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.isin(*DEGRADING))) > 0
    return (
        F.when((status == "indexed") & (state == "partly_prepared"), F.when(shown, arr("open_anyway", "view_details")).otherwise(arr("open_anyway")))
        .when(status == "stale", arr("prepare_again", "open_anyway"))
        .when(status.isin("missing", "deleted"), arr("check_folder", "remove_from_results"))
        .when(status == "permission_denied", arr("show_in_folder"))
        .when(status == "failed", arr("prepare_again", "view_details"))
        .otherwise(F.array().cast("array<string>"))
    )


# States of files as users see them, and the source states that are searched or may be refreshed.
FILE_STATES = {"discovered": "waiting", "indexed": "ready", "stale": "needs_update", "missing": "file_not_found", "deleted": "file_not_found", "permission_denied": "could_not_prepare", "unsupported": "ignored", "failed": "partly_prepared"}
SEARCHABLE = ("active", "needs_update", "preparing")
REFRESHABLE = ("active", "needs_update", "missing", "permission_denied")


def file_state(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FILE_STATES.items() for x in kv]), status)


def is_searchable(source_state: Column) -> Column:
    return source_state.isin(*SEARCHABLE)


def can_refresh(source_state: Column) -> Column:
    return source_state.isin(*REFRESHABLE)


@dataclass(frozen=True)
class Privacy:
    """What may be stored. Mode: standard, strict, portable or diagnostics; strict overrides every switch."""

    mode: str = "standard"
    recent_searches: bool = True
    snippets: bool = True
    diagnostics_paths: bool = False

    def keeps_recent_searches(self) -> bool:
        return self.mode != "strict" and self.recent_searches

    def keeps_snippets(self) -> bool:
        return self.mode != "strict" and self.snippets

    def shows_paths(self) -> bool:
        return self.mode != "strict" and self.diagnostics_paths
