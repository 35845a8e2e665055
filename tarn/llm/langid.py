"""Language identification by a blended-spectrum string kernel.

A text is cut into blocks of ``BLOCK`` code points; a block is the set of its letter n-grams of one
to three code points (all that is not a letter counts as a space), hashed to ``BUCKETS`` buckets.
The kernel of two blocks is the cosine of their presence vectors. Landmark blocks give a Nyström
map, on which one ridge regression for each language against the rest is solved. As the kernel is
an inner product, landmarks and ridge weights fold into one matrix of buckets by languages, and a
batch of blocks is scored by one matrix product. A document's scores are the means over all its
blocks, weighted by length. What makes probabilities of them is fitted on the halves of the sample that the other half did not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import map_text

BLOCK, BUCKETS = 2_000, 8_192
#: Bounds of the training sample: documents of each language, read whole, and landmarks (or one for each language).
DOCS_PER_LANG, LANDMARKS = 240, 256
RIDGE, UNKNOWN = 1e-2, "und"
#: Range of the factor that makes scores log-odds.
SHARPNESS = (1.0, 64.0)
#: Blocks that are unpacked at a time.
CHUNK = 512
#: Code points of a text that are scored at a time, whole blocks.
SLICE = 200 * BLOCK

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for start in range(0, 0x110000, 0x1000):
            for c in range(start, start + 0x1000):
                if chr(c).isalpha():
                    table[c] = c
        _letters.append(table)
    return _letters[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks by buckets of 0 and 1, document of each block, letters of each block); texts without a letter have no block."""
    table, rows, weights, docs, n = _letter_table(), [], [], [], 0
    flat: list[np.ndarray] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        c = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if not (c != 32).any():
            continue
        gap = c == 32
        c = c[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint64)
        c = np.concatenate([c, np.full(2, 32, dtype=np.uint64)])
        m = len(c) - 2
        block = np.arange(m) // BLOCK
        h1 = c[:m] + np.uint64(1)
        h2 = h1 * np.uint64(0x9E3779B97F4A7C15) + c[1 : m + 1]
        h3 = h2 * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
        for h in (h1, h2, h3):
            cell = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 13)
            flat.append((block + n) * BUCKETS + cell.astype(np.int64))
        weights.append(np.bincount(block, weights=c[:m] != 32))
        docs.append(np.full(block[-1] + 1, k))
        n += int(block[-1]) + 1
    rows = np.zeros(n * BUCKETS, dtype=np.uint8)
    for cells in flat:
        rows[cells] = 1
    none = np.zeros(0, dtype=np.int64)
    return rows.reshape(n, BUCKETS), np.concatenate(docs or [none]), np.concatenate(weights or [none])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(left + RIDGE * np.eye(len(left)), right)


def learn(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, float]:
    """(languages in order, buckets by languages, sharpness). Blocks are held as bits, and unpacked some at a time."""
    bits, owner, mass = [], [], []
    for k, text in enumerate(texts):
        for at in range(0, len(text), SLICE):
            x, _, weight = presence([text[at : at + SLICE]])
            if len(x):
                bits.append(np.packbits(x, axis=1))
                owner.append(np.full(len(x), k))
                mass.append(weight)
    if not bits:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32), SHARPNESS[0]
    bits, owner, mass = np.concatenate(bits), np.concatenate(owner), np.maximum(np.concatenate(mass), 1e-3)
    names = sorted({langs[k] for k in np.unique(owner)})
    place = {name: i for i, name in enumerate(names)}
    truth = np.array([place.get(x, 0) for x in langs])
    label = truth[owner]
    unpacked = lambda rows: _unit(np.unpackbits(bits[rows], axis=1))
    # landmarks: evenly spaced blocks of every language
    share = max(1, LANDMARKS // len(names))
    marks = np.concatenate([r[np.unique(np.linspace(0, len(r) - 1, share).astype(int))] for r in (np.flatnonzero(label == i) for i in range(len(names)))])
    z = unpacked(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([(unpacked(np.arange(i, min(i + CHUNK, len(bits)))) @ z.T).astype(np.float64) @ whiten for i in range(0, len(bits), CHUNK)]).astype(np.float32)
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.maximum(np.bincount(label, minlength=len(names)), 1)[label]
    # a language's documents go to both halves
    turn = np.zeros(len(texts), dtype=np.int64)
    for i in range(len(names)):
        own = np.flatnonzero(truth == i)
        turn[own] = np.arange(len(own)) % 2
    parts = [(phi[f].T @ (phi[f] * weight[f][:, None]).astype(np.float64), phi[f].T @ (target[f] * weight[f][:, None])) for f in (turn[owner] == 0, turn[owner] == 1)]
    out = np.zeros((len(texts), len(names)))
    total = np.bincount(owner, mass, minlength=len(texts))
    for f in (0, 1):
        own = turn[owner] == f
        np.add.at(out, owner[own], (phi[own] @ _solve(*parts[1 - f])) * mass[own][:, None])
    told = np.flatnonzero(total)
    raw, gold = out[told] / total[told][:, None], truth[told]
    heats = np.geomspace(*SHARPNESS, 25)

    def loss(s: float) -> float:
        v = s * raw
        top = v.max(axis=1, keepdims=True)
        return float((top[:, 0] + np.log(np.exp(v - top).sum(axis=1)) - v[np.arange(len(gold)), gold]).mean())

    beta = _solve(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1])
    return names, (z.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32), float(min(heats, key=loss))


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages in order, buckets by languages)."""
    return learn(texts, langs)[:2]


def score(texts: list[str | None], names: list[str], matrix: np.ndarray, sharpness: float = 4.0) -> tuple[list[str], list[float]]:
    """Language and probability of every text; ``und`` and 0 where there is no letter or no language was learned."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    total, mass = np.zeros((len(texts), len(names))), np.zeros(len(texts))
    group: list[tuple[int, str]] = []

    def flush() -> None:
        x, doc, weight = presence([t for _, t in group])
        raw = (x.astype(np.float32) @ matrix) / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1))[:, None]
        weight = np.maximum(weight, 1e-3)
        owner = np.array([k for k, _ in group], dtype=np.int64)[doc]
        np.add.at(total, owner, raw * weight[:, None])
        np.add.at(mass, owner, weight)
        group.clear()

    size = 0
    for k, text in enumerate(texts if names else []):
        for at in range(0, len(text or ""), SLICE):
            group.append((k, text[at : at + SLICE]))
            size += len(group[-1][1]) + BLOCK
            if size >= 2 * SLICE:
                flush()
                size = 0
    if group:
        flush()
    for k in np.flatnonzero(mass):
        s = sharpness * total[k] / mass[k]
        e = np.exp(s - s.max())
        best = int(np.argmax(s))
        langs[k], scores[k] = names[best], round(float(e[best] / e.sum()), 6)
    return langs, scores


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> tuple[list[str], list[str]]:
    """A bounded sample: for each language the documents of the smallest id hashes, out of those whose crc32(id) mod 5 is not 0."""
    ids = docs.where(F.col(lang).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 5 != 0)).select(
        F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    top = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS_PER_LANG)
    chosen = F.broadcast(top.select(F.col("id").alias("_id"), F.col("lang").alias("_lang")))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    # an id may have many texts
    place = Window.partitionBy("_lang").orderBy("_id", F.xxhash64("_text"))
    rows = own.join(chosen, ["_id", "_lang"]).distinct().withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= 2 * DOCS_PER_LANG)
    rows = rows.orderBy("_lang", "_rank").select("_text", "_lang").toArrow()
    return [t or "" for t in rows["_text"].to_pylist()], rows["_lang"].to_pylist()


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, names: tuple[str, str] = ("_lang_pred", "_score")) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, or with ``keep`` those columns and two more, ``names``.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no labelled text with a letter exists. Ties go to the first language in alphabetical order. Rows with a null id
    are never held out and never learned from. Repeated rows each give a row.
    """
    if keep is not None and (clash := {c.lower() for c in keep} & {n.lower() for n in names}):
        raise ValueError(f"columns exist already: {sorted(clash)}; give other names")
    known, matrix, sharpness = learn(*training_rows(docs, doc_id, text, lang))

    def run(part: pa.RecordBatch) -> list:
        langs, scores = score(part.column(part.num_columns - 1).to_pylist(), known, matrix, sharpness)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    if keep is not None:
        return map_text(docs, {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}, text, "lang_pred string, score double", run, most=1 << 20).toDF(*keep, *names)
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
    return map_text(docs, {"doc_id": F.col(doc_id), "held_out": held}, text, "lang_pred string, score double", run, most=1 << 20)
