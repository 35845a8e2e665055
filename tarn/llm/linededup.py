"""Cross-site boilerplate lines, found by the spread of each line over distinct sites.

One aggregation merges a HyperLogLog sketch of the sites for each line hash. Estimates clearly above
or below the threshold decide at once; lines whose estimate lies within the sketch's error get an
exact distinct count. The first copy of a boilerplate line (smallest document, then position)
stays, so that no text is lost from the corpus; every other copy is removed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialize, unique_names

MIN_SITES, LG_K = 10, 12
#: ASCII white space; a line of nothing else is never boilerplate.
BLANK = " \t\r\x0b\x0c"


def lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(doc, th, site, pos, h1, h2): a row for each line with a word; th tells apart documents of one id, h1 and h2 are a 128-bit key of the line."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("th"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    return rows.where(F.btrim("line", F.lit(BLANK)) != "").select("doc", "th", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first) of lines on ``min_sites`` distinct sites or more; null sites count as none."""
    error = 3 * 1.04 / math.sqrt(1 << lg_k)
    low, high = min(min_sites * (1 - error), min_sites - 1), max(min_sites * (1 + error), min_sites + 1)
    spread = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc", "th", "pos")).alias("first"))
    spread = materialize(spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high)
    exact = rows.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n"))
    sure = near.join(exact.where(F.col("n") >= min_sites), ["h1", "h2"], "left_semi")
    return spread.where(F.col("sites") > high).union(sure).select("h1", "h2", "first")


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, names: tuple[str, str, str] = ("_kept_text", "_lines", "_removed")) -> DataFrame:
    """``docs`` with three columns added, ``names``: the text that is left, and the numbers of lines and of removed ones.

    Lines are what lies between newlines, compared as they are. Null texts stay null with no lines;
    an empty text has one line; long texts are split whole. Rows that repeat both id and text count as one document, so
    each keeps its first copies; of copies in several documents that of the smallest id stays, then of the smallest text hash. Null ids
    sort first. No rows give no rows. Columns of ``docs`` with one of ``names`` are refused.
    """
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns exist already: {sorted(clash)}; give other names")
    own_doc, own_th, gone, split = unique_names(docs, "doc", "th", "drop", "parts")
    rows = materialize(lines(docs, doc_id, text, site), "lines")
    bad = boilerplate(rows, min_sites, lg_k)
    copies = rows.join(bad, ["h1", "h2"]).where(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first")))
    drop = copies.groupBy("doc", "th").agg(F.collect_set("pos").alias(gone)).select(F.col("doc").alias(own_doc), F.col("th").alias(own_th), gone)
    body = F.col(f"`{text}`").cast("string")
    joined = docs.join(drop, F.col(f"`{doc_id}`").eqNullSafe(F.col(own_doc)) & (F.xxhash64(body) == F.col(own_th)), "left")
    # a column of its own: inside a lambda the split would run again for each line
    joined = joined.withColumn(split, F.when(F.col(gone).isNotNull(), F.split(body, "\n")))
    parts = F.col(split)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), body).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        kept.alias(names[0]),
        n_lines.cast("bigint").alias(names[1]),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(names[2]),
    )
