"""Quality of documents by hierarchical empirical Bayes over hosts and their paths.

A logistic regression on counts of the text gives each document a probability, calibrated to the labels' share of good documents. Its sums over all
documents by host and by the leading parts of the path, gathered in one aggregation for each level, give posteriors: a host's mean shrinks toward
the global mean, a path's toward that of the path above it, by strengths that the method of moments finds from
the spread of the means. A document's final odds are by Bayes' rule those of its own evidence, with the global prior
exchanged for the posterior of its path, in which the document itself is counted at no level. No weight is set by hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import blobs, map_text, materialize
from tarn.llm.rules import DIGITS, SYMBOLS, UPPER, base_counts, sample, without

#: Bound of the training sample: documents of each label, read whole.
TRAIN_DOCS, RIDGE = 1_000, 1.0
MIN_QUALITY = 0.5
#: Parts of a path that are levels of their own; deeper paths belong to their first parts.
DEPTH = 3
#: Limits of the prior strengths, in documents, for levels that tell too little.
STRENGTH = (2.0, 1_000.0)
FLOOR = 1e-6


def features(blob: bytes | None) -> list[float]:
    blob = blob or b""
    n, chars, symbols, dup, again, _, lines = base_counts(blob)
    n1, c1 = max(n, 1), max(chars, 1)
    return [1.0, np.log1p(n), min(1.0, 10 * symbols / c1), min(1.0, 4 * without(blob, UPPER) / c1), min(1.0, 4 * without(blob, DIGITS) / c1), dup / max(len(lines), 1), again / n1, min(2.0, chars / n1 / 10), float(n < 20), min(1.0, 5 * blob.count(b"!!") / n1), min(1.0, 5 * without(blob, SYMBOLS) / n1)]


def fit(texts: list[bytes], labels: list[int], share: float | None = None) -> np.ndarray | None:
    """Ridge-penalised logistic regression by Newton steps, for a corpus with this share of label 1; None without both labels."""
    if len(set(labels)) < 2:
        return None
    x, y = np.array([features(t) for t in texts]), np.array(labels, dtype=float)
    w, penalty = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if share is not None:
        # the sample has other shares of the labels than the corpus
        w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return w


def evidence(docs: DataFrame, model: np.ndarray | None, keys: dict[str, Column], text: str) -> DataFrame:
    """``keys`` and p, the probability that the text alone gives; 0.5 without a model."""

    def run(part: pa.RecordBatch) -> list:
        texts = blobs(part.column(part.num_columns - 1))
        if model is None or not texts:
            return [pa.array([0.5] * len(texts), pa.float64())]
        z = np.array([features(t) for t in texts]) @ model
        return [pa.array(np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), FLOOR, 1 - FLOOR))]

    return map_text(docs, keys, text, "p double", run)


def strength(n: float, groups: int, squares: float, spread: float, within: float) -> float:
    """Documents that the prior of a level is worth: variance within groups over that between them, by moments.

    ``n``: documents of all groups; ``squares``: sum of their squared sizes; ``spread``: sum of size times squared distance from the parent; ``within``: sum of squares within.
    """
    if groups < 2 or n <= groups:
        return STRENGTH[1]
    own = max(within / (n - groups), 1e-6)
    between = (spread - (groups - 1) * own) / max(n - squares / n, 1.0)
    return float(np.clip(own / between if between > 0 else STRENGTH[1], *STRENGTH))


def levels(host: Column, path: Column) -> list[Column]:
    """Keys of a document from its host down: host, then its path's first parts; null where the path is not so deep."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return [F.concat(F.lit("h"), F.coalesce(host, F.lit("")), F.when(host.isNull(), "0").otherwise("1")), *[F.get(parts, F.lit(i)) for i in range(DEPTH)]]


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, kept) of every row; the posteriors are without the document itself.

    Null hosts are a host of their own; a null path is the host's root. Null and empty texts are judged by their counts like any
    other; long texts are read whole. Without labelled documents of both labels all evidence is 0.5 and every document
    is kept. Repeated rows each give a row; a quality of exactly ``MIN_QUALITY`` is kept; a label that stands twice with two values is 0.
    """
    count = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y")).agg(F.avg("y").alias("y")).first()["y"]
    share = None if count is None else float(np.clip(count, 0.01, 0.99))
    model = fit(*sample(docs, labels, doc_id, text, label, TRAIN_DOCS), share)
    names = ["host", *[f"p{i}" for i in range(DEPTH)]]
    scored = materialize(evidence(docs, model, {"doc_id": F.col(f"`{doc_id}`"), **dict(zip(names, levels(host, path)))}, text), "evidence")
    groups = materialize(scored.groupBy(*names).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "groups")
    total = groups.agg(F.sum("n"), F.sum("s")).first()
    all_n, all_s = float(total[0] or 0), float(total[1] or 0.0)
    mean = float(np.clip(all_s / all_n if all_n else 0.5, FLOOR, 1 - FLOOR))
    # each level's groups with their own sums and the posterior of the level above
    wide, up, strong = groups, F.lit(mean), []
    for k in range(len(names)):
        keys = names[: k + 1]
        whole = F.col(keys[-1]).isNotNull()
        sums = groups.where(whole).groupBy(*keys).agg(F.sum("n").alias(f"n{k}"), F.sum("s").alias(f"s{k}"), F.sum("q").alias(f"q{k}"))
        sums = sums.select(*[F.col(c).alias(f"_{c}") for c in keys], f"n{k}", f"s{k}", f"q{k}")
        same = F.lit(True)
        for c in keys:
            same = same & (F.col(c) == F.col(f"_{c}"))
        wide = wide.join(sums, same, "left").drop(*[f"_{c}" for c in keys]).withColumn(f"up{k}", up)
        n, s, q = (F.col(f"{x}{k}") for x in "nsq")
        one = wide.where(whole).groupBy(*keys).agg(*[F.first(f"{x}{k}").alias(f"{x}{k}") for x in ("n", "s", "q", "up")])
        row = one.agg(F.sum(n), F.count("*"), F.sum(n * n), F.sum(n * F.pow(s / n - F.col(f"up{k}"), 2)), F.sum(q - s * s / n)).first()
        strong.append(strength(*[float(v or 0) for v in row]))
        up = F.when(n.isNull(), F.col(f"up{k}")).otherwise((s + strong[k] * F.col(f"up{k}")) / (n + strong[k]))
    wide = materialize(wide.select(*[F.col(c).alias(f"_{c}") for c in names], *[f"{x}{k}" for k in range(len(names)) for x in "ns"]), "paths")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # down the levels again, each without the document itself
    p, post, posts = F.col("p"), F.lit(mean), []
    for k, kappa in enumerate(strong):
        n, s = F.col(f"n{k}"), F.col(f"s{k}")
        post = F.when(n.isNull(), post).otherwise((s - p + kappa * post) / (n - 1 + kappa))
        posts.append(post)
    joined = scored.join(wide, same)
    clip = lambda c: F.least(F.greatest(c, F.lit(FLOOR)), F.lit(1 - FLOOR))
    logit = lambda c: F.ln(c / (1 - c))
    out = joined.select("doc_id", p, clip(posts[0]).alias("host_posterior"), clip(posts[-1]).alias("path_posterior"))
    odds = logit(p) + logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    r = {c: F.round(c, 6).alias(a) for c, a in (("p", "evidence"), ("host_posterior", "host_posterior"), ("path_posterior", "path_posterior"), ("quality", "quality"))}
    return out.select("doc_id", *r.values(), (F.col("quality") >= MIN_QUALITY).alias("kept"))
