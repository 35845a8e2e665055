"""Reports as JSON and Markdown, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One text for each topic; a corpus of any size cycles through them.
TOPICS = {
    "auth": "# Authentication\n\nAccess tokens live one hour. Refresh tokens are rotated on use.\nA request with an expired token fails with ERR-4042.",
    "storage": "# Storage\n\nTables are written whole and replaced by moving one pointer.\nOld versions are removed afterwards.",
    "search": "# Search\n\nKeyword and vector candidates are fused by reciprocal ranks.\nThe best results get a snippet.",
    "api": "# Interface\n\nCalls are limited for each client; a client over its limit has to wait.",
    "security": "# Security\n\nSecrets are kept out of logs. Paths are checked before they are read.",
    "japanese": "# 認証\n\n認証トークンのローテーション。期限切れのトークンは ERR-4042 で失敗する。",
    "code": "# Code\n\n```python\ndef answer():\n    return 42\n```\n\nThe function gives a number.",
    "models": "# Models\n\nAn embedding model turns a text into a vector of unit length.",
}


def synthetic_corpus(spark: SparkSession, n: int) -> DataFrame:
    """(name, text) of n documents, made on the executors."""
    names, texts = (F.array(*[F.lit(x) for x in xs]) for xs in (TOPICS, TOPICS.values()))
    at = (F.col("id") % len(TOPICS) + 1).cast("int")
    return spark.range(n).select(F.format_string("%s-%04d.md", F.element_at(names, at), F.col("id")).alias("name"), F.concat(F.element_at(texts, at), F.lit("\n\nDocument "), F.col("id").cast("string"), F.lit(".\n")).alias("text"))


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def to_markdown(metrics: dict[str, object], title: str) -> str:
    rows = "\n".join(f"| {k} | {v} |" for k, v in metrics.items())
    return f"# {title}\n\n| Metric | Value |\n|---|---|\n{rows}\n"
