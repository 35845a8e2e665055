"""Folders as tables: scans, admission policy, type classes, hashes and path guards."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import extension, file_name
from tarn.sources import folder

# Default excludes, supported extensions, sensitive places.
DEFAULT_EXCLUDES = (".git", "node_modules", "target", "dist", "build", ".cache", ".venv", "__pycache__")
EXTENSIONS = ("txt", "log", "md", "markdown", "html", "htm", "pdf", "docx", "csv", "rs", "py", "js", "ts", "jsx", "tsx", "java", "c", "h", "cpp", "hpp", "go", "rb", "php", "sh", "bash", "sql", "toml", "yaml", "yml", "json", "xml", "css")
SYSTEM_PREFIXES = ("/etc", "/usr", "/bin", "/sbin", "/boot", "/proc", "/sys")
CREDENTIAL_FOLDERS = (".ssh", ".gnupg", ".aws", ".azure", ".kube", ".docker", ".password-store", ".mozilla", ".thunderbird")


@dataclass(frozen=True)
class ScanPolicy:
    """Which files of a source are taken. Patterns are a name or ``*.ext``; no include pattern takes all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_bytes: int | None = None
    hidden: bool = False
    default_excludes: tuple[str, ...] = field(default=DEFAULT_EXCLUDES)

    def admits(self, path: Column, size: Column) -> Column:
        """``path`` is relative to the source."""
        parts = F.split(path, "/")
        name, ext = file_name(path), F.coalesce(extension(path), F.lit(""))
        names = [*self.default_excludes, *(p for p in self.exclude if not p.startswith("*."))]
        bad = [p[2:].lower() for p in self.exclude if p.startswith("*.")]
        good = [p[2:].lower() for p in self.include if p.startswith("*.")]
        good_names = [p for p in self.include if not p.startswith("*.")]
        out = ~F.exists(parts, lambda p: p.isin(*names))
        if bad:
            out &= ~ext.isin(*bad)
        if good or good_names:
            out &= ext.isin(*good) if not good_names else name.isin(*good_names) | (ext.isin(*good) if good else F.lit(False))
        if not self.hidden:
            out &= ~has_hidden_component(path)
        if self.max_bytes is not None:
            out &= size <= self.max_bytes
        return out


def has_hidden_component(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def type_class(path: Column) -> Column:
    return F.when(extension(path).isin(*EXTENSIONS), "supported").otherwise("unsupported")


def sensitive_warning(path: Column) -> Column:
    """Why a folder should not be indexed without a question, or null. The path's first match decides."""
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system |= path.startswith(p)
    hits = F.transform(F.split(path, "/"), lambda p: F.when(p.isin(*CREDENTIAL_FOLDERS), "credential_directory").when(p == ".config", "hidden_configuration_directory"))
    return F.when(system, "system_directory").otherwise(F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)))


def guard(path: Column, roots: list[str], policy: ScanPolicy, size: Column) -> Column:
    """Null if a path may be read, else why not: outside_source, hidden, too_large."""
    inside = F.lit(False)
    for r in roots:
        inside |= path.startswith(r.rstrip("/") + "/")
    out = F.when(path.rlike(r"(^|/)\.\.(/|$)") | ~inside, "path_outside_source")
    if not policy.hidden:
        out = out.when(has_hidden_component(path), "hidden_file")
    return out.when(size > policy.max_bytes, "file_too_large") if policy.max_bytes is not None else out


class PathRefused(ValueError):
    """A path that may not be read, and why."""


def validated_path(path: str, roots: list[str], policy: ScanPolicy = ScanPolicy(), follow_links: bool = False) -> str:
    """The canonical form of a local path, as the driver sees it; raises ``PathRefused`` outside the roots, behind a link, hidden or too large."""
    real = os.path.realpath(path)
    root = next((r for r in map(os.path.realpath, roots) if real == r or real.startswith(r.rstrip("/") + "/")), None)
    if root is None:
        raise PathRefused("path_outside_source")
    asked = os.path.abspath(path)
    if not follow_links and asked.startswith(root + "/") and linked_below(root, asked):
        raise PathRefused("symlink_policy_blocked")
    if not policy.hidden and any(c.startswith(".") for c in os.path.relpath(real, root).split("/") if c != "."):
        raise PathRefused("hidden_file_excluded")
    if policy.max_bytes is not None and os.path.isfile(real) and os.path.getsize(real) > policy.max_bytes:
        raise PathRefused("file_too_large")
    return real


def linked_below(root: str, path: str) -> bool:
    """Whether a component of a path below the root is a symbolic link."""
    parts = os.path.relpath(path, root).split("/")
    return any(os.path.islink(os.path.join(root, *parts[: i + 1])) for i in range(len(parts)))


def listed_folder(spark: SparkSession, root: str, policy: ScanPolicy = ScanPolicy(), source_id: str = "source", follow_links: bool = False, stream: bool = False, settle: int = 0) -> DataFrame:
    """(source_id, path, display_path, size_bytes, modified_at, problem): admitted files, and with ``problem`` (permission_denied, failed) what could not be listed.

    Tasks list the folder, so all executors must see it under this path. Directories that the policy leaves out are not entered.
    """
    folder.register(spark)
    names = [*policy.default_excludes, *(p for p in policy.exclude if not p.startswith("*."))]
    read = (spark.readStream if stream else spark.read).format("folder").option("skip", json.dumps(names)).option("hidden", policy.hidden).option("followLinks", follow_links)
    rows = (read.option("settle", settle) if stream else read).load(root)
    admitted = policy.admits(F.col("display_path"), F.col("size_bytes"))
    return rows.where(F.col("problem").isNotNull() | admitted).select(F.lit(source_id).alias("source_id"), *rows.columns)


def scan_folder(spark: SparkSession, root: str, policy: ScanPolicy = ScanPolicy(), source_id: str = "source", content: bool = False, follow_links: bool = False) -> DataFrame:
    """(source_id, path, display_path, size_bytes, modified_at[, content, content_hash]) of the admitted files of a folder.

    Names that start with a dot or an underscore are there, as the policy wants; symbolic links are left out unless ``follow_links``, and then
    taken only within the folder. Contents are read, on the executors, only if asked for. A file that can't be read has a null content. Folders of other
    file systems than the executors' own are listed by Spark's file source, which leaves out names that start with a dot or an underscore.
    """
    if "://" in root and not root.startswith("file://"):
        out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        display = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
        out = out.select(F.lit(source_id).alias("source_id"), "path", display.alias("display_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
        out = out.where(policy.admits(F.col("display_path"), F.col("size_bytes")))
    else:
        out = listed_folder(spark, root, policy, source_id, follow_links).where("problem is null").drop("problem")
    if content:
        from tarn.operators.extract import read_files

        out = read_files(out).drop("read_error").withColumn("content_hash", F.sha2("content", 256))
    return out


def fingerprint_changed(old_size: Column, old_time: Column, new_size: Column, new_time: Column) -> Column:
    return ~(old_size.eqNullSafe(new_size) & old_time.eqNullSafe(new_time))


def path_state(root: str) -> str:
    """active, permission_problem or folder_not_found, as the driver sees a local folder."""
    if not os.path.isdir(root):
        return "folder_not_found"
    return "active" if os.access(root, os.R_OK | os.X_OK) else "permission_problem"
