"""Quality rules: counts of a text, and a linear-chain conditional random field over its lines.

The field labels each line with a word content or boilerplate and is decoded by Viterbi. It is trained on a bounded sample of
labelled documents, read whole. Lines get their labels from the corpus: in a document of quality 1 a line is boilerplate if, over
all documents, it follows ``MIN_CONTEXTS`` different lines or more, and content otherwise, so that labels change within a document; copies of
a document do not make its lines boilerplate, as the line before is a copy too. All lines of a document of quality 0 are
boilerplate. A document is kept if the counts pass and at least ``MIN_SHARE`` of its words stand in content lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import blobs, map_text

SYMBOLS, WINDOW = b"#*$%&|<>", 8
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 20, 30, 0.5
#: Bound of the training sample: documents of each label.
TRAIN_DOCS = 400
#: Lines that are trained on as one sequence; a longer document gives several.
SEQUENCE = 64
#: Different lines before a line from which on it is boilerplate.
MIN_CONTEXTS = 5
ROUNDS, RATE, RIDGE = 200, 0.5, 1e-2
#: Losing a content line weighs as much as letting so many boilerplate lines pass.
CONTENT_WEIGHT = 3.0

SPACES, DIGITS, UPPER = b" \t\n\r\x0b\x0c", b"0123456789", bytes(range(65, 91))
MULTIPLY = [np.uint64(x) for x in np.random.default_rng(8).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def without(blob: bytes, chars: bytes) -> int:
    """How many of ``chars`` a text has."""
    return len(blob) - len(blob.translate(None, chars))


def repeated(words: list[bytes]) -> np.ndarray | None:
    """Which words stand in a window that occurs twice or more; None if there are none."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return None
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n] * MULTIPLY[0]
    for i in range(1, WINDOW):
        key += h[i : n + i] * MULTIPLY[i]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return None
    # hashes only nominate: the windows themselves are counted
    starts = np.flatnonzero(np.isin(key, twice))
    seen: dict[tuple, int] = {}
    for s in starts:
        w = tuple(words[s : s + WINDOW])
        seen[w] = seen.get(w, 0) + 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s in starts:
        if seen[tuple(words[s : s + WINDOW])] > 1:
            edge[s] += 1
            edge[s + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def base_counts(blob: bytes | None) -> tuple[int, int, int, int, int, np.ndarray | None, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the repeated words and the lines with a word."""
    blob = blob or b""
    words = blob.split()
    lines = [x for x in blob.split(b"\n") if x and not x.isspace()]
    mask = repeated(words)
    chars = len(blob.decode("utf-8", "replace")) - without(blob, SPACES)
    return len(words), chars, without(blob, SYMBOLS), len(lines) - len(set(lines)), 0 if mask is None else int(mask.sum()), mask, lines


FEATURES = 18


def line_features(lines: list[bytes], mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines by features of 0 and 1, words of each line)."""
    rows, sizes, seen, at = [], [], set(), 0
    for x in lines:
        n, w = len(x), x.split()
        symbols, upper, digits = without(x, SYMBOLS) / n, without(x, UPPER) / n, without(x, DIGITS) / n
        mean = (n - without(x, SPACES)) / len(w)
        again = 0.0 if mask is None else float(mask[at : at + len(w)].mean())
        at += len(w)
        last = x.rstrip()[-1:]
        rows.append(
            (1, symbols > 0.01, symbols > 0.04, symbols > 0.1, upper > 0.2, upper > 0.5, digits > 0.1, digits > 0.3, n < 20, n < 60, n > 400, len(w) < 3, mean > 9, mean < 3, x in seen, again > 0.2, again > 0.6, last not in b".!?")
        )
        seen.add(x)
        sizes.append(len(w))
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(sizes, dtype=np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of one sequence (0 boilerplate, 1 content; ties go to content)."""
    if not len(emit):
        return np.zeros(0, dtype=np.int8)
    (m00, m01), (m10, m11) = move.tolist()
    scores = emit.tolist()
    s0, s1 = scores[0]
    back = []
    for e0, e1 in scores[1:]:
        a0, a1 = s0 + m00, s1 + m10
        b0, b1 = s0 + m01, s1 + m11
        back.append((a1 >= a0, b1 >= b0))
        s0, s1 = max(a0, a1) + e0, max(b0, b1) + e1
    label = [s1 >= s0]
    for from0, from1 in reversed(back):
        label.append(from1 if label[-1] else from0)
    return np.array(label[::-1], dtype=np.int8)


def train(texts: list[bytes], labels: list[int], spread: frozenset[bytes] = frozenset()) -> tuple[np.ndarray, np.ndarray] | None:
    """(features by labels, label by next label) of greatest likelihood; None without both labels. ``spread``: boilerplate lines of good documents."""
    seqs = []
    for blob, y in zip(texts, labels):
        *_, mask, lines = base_counts(blob)
        x = line_features(lines, mask)[0]
        own = np.array([int(y == 1 and line not in spread) for line in lines], dtype=np.int64)
        seqs += [(x[i : i + SEQUENCE], own[i : i + SEQUENCE], y, len(lines)) for i in range(0, len(lines), SEQUENCE)]
    if len({y for *_, y, _ in seqs}) < 2:
        return None
    d, t = len(seqs), max(len(x) for x, *_ in seqs)
    x, gold = np.zeros((d, t, FEATURES)), np.zeros((d, t, 2))
    valid = np.zeros((d, t), dtype=bool)
    for i, (f, own, *_) in enumerate(seqs):
        x[i, : len(f)], valid[i, : len(f)] = f, True
        gold[i, np.arange(len(own)), own] = 1
    y = np.array([y for *_, y, _ in seqs])
    # a document weighs one, however many sequences it has
    share = np.array([len(f) / n for f, _, _, n in seqs])
    weight = (np.where(y == 1, CONTENT_WEIGHT, 1.0) * share / np.bincount(y, share, minlength=2)[y])[:, None]
    pair = valid[:, 1:] & valid[:, :-1]
    w, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(move)
    for _ in range(ROUNDS):
        emit = (x @ w) * valid[..., None]
        fwd, bwd = np.zeros((d, t, 2)), np.zeros((d, t, 2))
        fwd[:, 0] = emit[:, 0]
        for i in range(1, t):
            step = np.logaddexp.reduce(fwd[:, i - 1, :, None] + move, axis=1) + emit[:, i]
            fwd[:, i] = np.where(valid[:, i, None], step, fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(move + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(valid[:, i + 1, None], step, 0)
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)[:, None, None]
        node = np.exp(fwd + bwd - total) * valid[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (emit + bwd)[:, 1:, None, :] - total[..., None]) * pair[..., None, None]
        size = valid.sum(axis=1)[:, None]
        grad = np.einsum("dtf,dtk->fk", x, (gold - node) * (weight / size)[..., None]) / 2 - RIDGE * w
        true = gold[:, :-1, :, None] * gold[:, 1:, None, :] * pair[..., None, None]
        grad_m = ((true - edge) * (weight / size)[..., None, None]).sum(axis=(0, 1)) / 2 - RIDGE * move
        speed_w, speed_m = 0.9 * speed_w + grad, 0.9 * speed_m + grad_m
        w, move = w + RATE * speed_w, move + RATE * speed_m
    return w, move


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of up to ``per_label`` labelled documents of each label 0 and 1: those of the smallest id hashes."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"))
    top = None
    for y in (0, 1):
        part = known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        top = part if top is None else top.union(part)
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    # 2 * per_label ids; of an id's texts that of the smallest hash counts
    rows = own.join(F.broadcast(top), "_id").where("_text is not null").groupBy("_label", "_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    table = rows.orderBy("_label", "_id").toArrow()
    return [t.encode() for t in table["_text"].to_pylist()], table["_label"].to_pylist()


def spread_lines(docs: DataFrame, text: str, texts: list[bytes]) -> frozenset[bytes]:
    """Those lines of the sample's ``texts`` that follow ``MIN_CONTEXTS`` different lines or more over all documents."""
    lines = sorted({x for t in texts for x in t.split(b"\n") if x and not x.isspace()})
    if not lines:
        return frozenset()
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, x.decode("utf-8", "replace")) for i, x in enumerate(lines)], "n int, line string")
    parts = F.filter(F.split(F.col(f"`{text}`").cast("string"), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    pairs = F.transform("parts", lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.when(i > 0, F.xxhash64(F.get(F.col("parts"), i - 1))).otherwise(F.lit(0)).alias("before")))
    rows = docs.select(parts.alias("parts")).select(F.inline(pairs)).join(F.broadcast(wanted.select("n", F.xxhash64("line").alias("h"))), "h")
    found = rows.groupBy("n").agg(F.count_distinct("before").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS)
    return frozenset(lines[r[0]] for r in found.select("n").collect())


def content_words(lines: list[bytes], mask: np.ndarray | None, model) -> int:
    """Words in lines that the field labels content."""
    if not lines:
        return 0
    x, sizes = line_features(lines, mask)
    return int(sizes[viterbi(x @ model[0], model[1]) == 1].sum())


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words) of every row.

    Null and empty texts have no words and fail the base rules. Without labelled documents of both
    labels there is no field, every line is content and the base rules decide alone.
    Repeated rows each give a row, null ids stay null, and a label that stands
    twice with two values is 0. Long texts are read whole; of equally good labellings a line is content.
    """
    texts, known = sample(docs, labels, doc_id, text, label, TRAIN_DOCS)
    model = train(texts, known, spread_lines(docs, text, [t for t, y in zip(texts, known) if y == 1]))

    def run(part: pa.RecordBatch) -> list:
        out = []
        for blob in blobs(part.column(part.num_columns - 1)):
            n, chars, symbols, dup, again, mask, lines = base_counts(blob)
            content = n if model is None else content_words(lines, mask, model)
            failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
            out.append((n, chars, symbols, dup, again, content, failed, not failed and content >= MIN_SHARE * n))
        return [pa.array([r[i] for r in out], pa.int64() if i < 6 else pa.bool_()) for i in range(8)]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")
    fields = ", ".join(f"{c} bigint" for c in names) + ", base_failed boolean, kept boolean"
    return map_text(docs, {"doc_id": F.col(doc_id)}, text, fields, run).select("doc_id", *names[:-1], "base_failed", "kept", names[-1])
