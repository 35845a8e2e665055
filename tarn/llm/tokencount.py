"""Token counts of a word-level BPE vocabulary, without making the tokens.

A word's symbols form a linked list and its adjacent pairs a heap. The pair of the lowest rank is
popped and merged again and again; the count is the number of first symbols less the number of
merges. Words repeat, so a bounded table keeps their counts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bpe import _byte_chars, vocabulary_path
from tarn.llm.common import map_text

VOCABULARY, LIMIT = "word_bpe_49k.json", 2_048
#: Words whose counts a worker keeps; the table is emptied when full.
TABLE = 400_000

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
#: str.split() takes these for white space, Unicode's property does not.
ODD = regex.compile("[\x1c-\x1f]")


class TokenCounter:
    """Counts for one vocabulary file of the tokenizers library: NFC, lower case, BPE with an end-of-word suffix."""

    def __init__(self, vocabulary: str | bytes):
        """``vocabulary``: a file's path or its contents."""
        spec = json.loads(vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes())
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.inner = [vocab.get(chars[b]) for b in range(256)]
        self.final = [vocab.get(chars[b] + suffix) for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.table: dict[str, int] = {}

    def merged(self, ids: list[int]) -> int:
        """Number of tokens that a list of symbols is merged to."""
        n = len(ids)
        if n < 2:
            return n
        pairs = self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := pairs.get(ids[i] << 20 | ids[i + 1]):
                heap.append((hit[0], i, hit[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            hit = pairs.get(ids[i] << 20 | ids[j])
            if hit is None or hit[0] != rank:
                continue
            ids[i], ids[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := pairs.get(new << 20 | ids[k]):
                    heapq.heappush(heap, (hit[0], i, hit[1]))
            h = before[i]
            if h >= 0 and (hit := pairs.get(ids[h] << 20 | new)):
                heapq.heappush(heap, (hit[0], h, hit[1]))
        return left

    def pretoken(self, token: str) -> int:
        raw = token.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self.merged([i for i in ids if i is not None])

    def word(self, word: str) -> int:
        """Tokens of a run of characters that are not white space."""
        n = sum(map(self.pretoken, PRETOKEN.findall(word)))
        if len(word) < 64:
            if len(self.table) >= TABLE:
                self.table.clear()
            self.table[word] = n
        return n

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        # letters are lower-cased one by one, so a final sigma is like any other
        text = text.replace("Σ", "σ").lower()
        get, total = self.table.get, 0
        for word in SPACE.split(text) if ODD.search(text) else text.split():
            n = get(word)
            total += self.word(word) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; special strings in it count one each."""
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[bytes, TokenCounter] = {}


def counter(held: Broadcast | str) -> TokenCounter:
    """The counter of a vocabulary that the driver sent, or of a file here; made once by each worker."""
    data = Path(held).read_bytes() if isinstance(held, str) else held.value
    key = hashlib.sha256(data).digest()
    if key not in _counters:
        _counters[key] = TokenCounter(data)
    return _counters[key]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows each give a row, null ids stay null.
    """
    # executors need no file: the vocabulary, a few MB, goes with the tasks
    held = docs.sparkSession.sparkContext.broadcast(Path(path or vocabulary_path(VOCABULARY)).read_bytes())

    def run(part: pa.RecordBatch) -> list:
        c, column = counter(held), part.column(part.num_columns - 1)
        n = pa.array([c.count(t) for t in column.to_pylist()], pa.int64())
        return [pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), n, pc.greater(n, limit)]

    return map_text(docs, {"doc_id": F.col(doc_id)}, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", run)
