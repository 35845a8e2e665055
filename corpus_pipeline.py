"""A training corpus from ``documents``: each stage works on what the one before it kept.

1. language_id: documents whose language is undetermined or told with a probability under ``MIN_SCORE`` go.
2. line_dedup: copies of lines that stand on ten sites or more go; documents that lose all their words go.
3. near_dedup: one document of each SimHash component stays.
4. decontamination: documents that hold a benchmark item go.
5. bpe: every text is encoded and decoded; a row of digests for each document.

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text where that changes.
Every stage is written as Parquet and read again by the next. Null texts and texts without a letter go in stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, decontam, langid, linededup, simhash
from tarn.llm.common import discard, materialize, release, scan, scratch, unique_names

#: The language that is told is likelier than all others together, however many they are.
MIN_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pred, score = unique_names(docs, "pred", "score")
    told = langid.identify(docs, keep=docs.columns, names=(pred, score))
    return told.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).drop(pred, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, lines, removed = unique_names(docs, "kept", "lines", "removed")
    out = linededup.remove_boilerplate(docs, names=(kept, lines, removed))
    left = F.btrim(F.col(kept), F.lit(linededup.BLANK + "\n")) != ""
    new = {"text": F.col(kept), "n_chars": F.length(kept).cast("bigint")}
    return out.where((F.col(removed) == 0) | left).select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, scan(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", encode)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's own tables and its predecessor's output are deleted once its output is written."""
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = materialize(stage(spark, docs, sf_dir), name)
            keep.append(out)
        discard(docs)
        docs = out
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
