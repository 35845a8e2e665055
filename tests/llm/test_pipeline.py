"""The pipeline against plain Python, stage by stage, and whole."""

import hashlib
import os

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as p  # noqa: E402
from tarn.llm import bpe, langid  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tests.llm.test_duplicates import brute_components, brute_fingerprint  # noqa: E402


def brute_lines(docs):
    spread, first = {}, {}
    for i, d in sorted(docs.items()):
        for n, line in enumerate(d["text"].split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                spread.setdefault(line, set()).add(d["source"])
                first.setdefault(line, (i, n))
    out = {}
    for i, d in docs.items():
        lines = d["text"].split("\n")
        kept = [x for n, x in enumerate(lines) if len(spread.get(x, ())) < 10 or first[x] == (i, n)]
        if len(kept) == len(lines) or any(x.strip(" \t\r\x0b\x0c") for x in kept):
            out[i] = {**d, "text": "\n".join(kept)}
    return out


def brute_copies(docs):
    ids = sorted(docs)
    roots = brute_components([brute_fingerprint(docs[i]["text"]) for i in ids])
    low = {}
    for i, r in zip(ids, roots):
        low.setdefault(r, i)
    return {i: docs[i] for i, r in zip(ids, roots) if low[r] == i}


def brute_clean(docs, items):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    wanted = [g for g in map(grams, items) if g]
    return {i: d for i, d in docs.items() if not any(len(g & grams(d["text"])) >= 0.8 * len(g) for g in wanted)}


def test_run(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.asDict() for r in source.collect()}
    names, matrix, sharpness = langid.learn(*langid.training_rows(source, "doc_id", "text", "lang"))
    ids = sorted(docs)
    langs, scores = langid.score([docs[i]["text"] for i in ids], names, matrix, sharpness)
    docs = {i: docs[i] for i, lang, s in zip(ids, langs, scores) if lang != "und" and s >= p.MIN_SCORE}
    docs = brute_clean(brute_copies(brute_lines(docs)), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    want = {i: (len(tokenizer.encode(d["text"], add_special_tokens=False).ids), hashlib.sha256(d["text"].encode()).hexdigest()) for i, d in docs.items()}
    rows = p.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)
