"""Byte-level BPE encoding and decoding of texts of any length, by tree concatenation.

A text longer than ``LEAF`` code points is halved until its leaves are short. Leaves are encoded on
their own and joined in pairs up the tree: a window around each join is encoded again and grows
until both sides agree with it. The window's left edge agrees if it lies where no pre-token can
span whatever surrounds it (``HARD``: after a non-space ASCII character and before a space, or between
ASCII character classes that no pre-token mixes), or if the window lies inside one run of a
single class and its outermost tokens come out as they were. The second is exact because a
sequence of BPE tokens is the encoding of its text if and only if every adjacent pair is the
encoding of its own text: no merge can cross a boundary that it does not cross in the pair alone.
Texts over ``LONG`` code points have their leaves dealt to all tasks before they are joined.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_text, small_batches

LEAF, LONG = 8_192, 65_536
#: Tokens on each side of a join that the first window holds.
WINDOW = 16
VOCABULARY = "byte_bpe_50k.json"

HARD = regex.compile(
    r"(?<=[!-~])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])"
)
RUN = regex.compile(r"\p{L}+|\p{N}+|\p{White_Space}+|[^\p{White_Space}\p{L}\p{N}']+")


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, vocabulary: str | bytes):
        """``vocabulary``: a file's path or its contents."""
        import tiktoken

        spec = json.loads(vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes())
        vocab = spec["model"]["vocab"]
        char_byte = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(char_byte[c] for c in token): i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.lengths = np.zeros(n, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self._special_bytes = {i: s.encode() for s, i in self.special.items()}

    def leaf(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens; a special token gives its own string."""
        if not self._special_bytes or not len(ids) or int(ids.max()) not in self._special_bytes:
            return self._encoding.decode_bytes(ids.tolist())
        out, start = [], 0
        for at in np.flatnonzero(np.isin(ids, list(self._special_bytes))):
            out += [self._encoding.decode_bytes(ids[start:at].tolist()), self._special_bytes[int(ids[at])]]
            start = at + 1
        return b"".join([*out, self._encoding.decode_bytes(ids[start:].tolist())])

    def parts(self, text: str) -> Iterator[str | int]:
        """Plain texts and special ids, in order."""
        if not self.cut or not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of a whole text; special strings in it become their ids, as the library does by default."""
        if len(text) <= leaf and (not self.cut or not any(s in text for s in self.special)):
            return self.leaf(text)
        out = [np.array([p], dtype=np.uint32) if isinstance(p, int) else self.tree([self.leaf(x) for x in leaves(p, leaf)]) for p in self.parts(text)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def tree(self, nodes: list[np.ndarray]) -> np.ndarray:
        """Join neighbours in pairs until one node is left."""
        while len(nodes) > 1:
            nodes = [self.join(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else np.zeros(0, dtype=np.uint32)

    def join(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Encoding of the concatenated texts of two encodings."""
        while True:
            a = left[max(0, len(left) - window) :]
            b = right[:window]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (out := self._agree(a, b, whole_left, whole_right)) is not None:
                return np.concatenate([left[: len(left) - len(a)], out, right[len(b) :]])
            window *= 2

    def _agree(self, a: np.ndarray, b: np.ndarray, whole_left: bool, whole_right: bool) -> np.ndarray | None:
        """Tokens in place of a and b, or None if the window has to grow."""
        ta, tb = self.decode(a), self.decode(b)
        edge_a, edge_b = self._edges(a), self._edges(b)
        # outermost token edges of each side at which its encoding is safe; None: none in the window
        lo = 0 if whole_left else next((i for i in range(len(a)) if self._hard(ta, edge_a[i])), None)
        hi = len(b) if whole_right else next((i for i in range(len(b), 0, -1) if self._hard(tb, edge_b[i])), None)
        if lo is not None and hi is not None:
            new = self.leaf((ta[edge_a[lo] :] + tb[: edge_b[hi]]).decode("utf-8"))
            return np.concatenate([a[:lo], new, b[hi:]])
        # inside one run: outermost tokens must come out again
        i = next((i for i in range(len(a)) if _starts(ta, edge_a[i])), None)
        j = next((j for j in range(len(b), 0, -1) if _starts(tb, edge_b[j])), None)
        if i is None or j is None:
            return None
        own = ta[edge_a[i] :].decode("utf-8")
        text = own + tb[: edge_b[j]].decode("utf-8")
        # with two characters on the left no contraction ('ll) can reach from before the window over the join
        if len(own) < 2 or RUN.fullmatch(text) is None:
            return None
        new = self.leaf(text)
        if len(new) < 2 or new[0] != a[i] or new[-1] != b[j - 1]:
            return None
        return np.concatenate([a[:i], new, b[j:]])

    def _edges(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    @staticmethod
    def _hard(text: bytes, at: int) -> bool:
        """Whether no pre-token can span this place, as the two ASCII characters beside it show."""
        if not 0 < at < len(text):
            return False
        return text[at - 1] < 128 and text[at] < 128 and HARD.match(text[at - 1 : at + 1].decode("ascii"), 1) is not None


def _starts(text: bytes, at: int) -> bool:
    """Whether a character starts, or the text's last one ends, at this byte."""
    if at < len(text):
        return text[at] & 0xC0 != 0x80
    lead = next((k for k in range(1, 5) if k <= at and text[at - k] & 0xC0 != 0x80), 0)
    return bool(lead) and lead == (1 if text[at - lead] < 0x80 else 2 if text[at - lead] < 0xE0 else 3 if text[at - lead] < 0xF0 else 4)


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Halves of halves, none longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return leaves(text[:mid], leaf) + leaves(text[mid:], leaf)


_codecs: dict[bytes, Codec] = {}


def codec(held: Broadcast | str) -> Codec:
    """The codec of a vocabulary that the driver sent, or of a file here; made once by each worker."""
    data = Path(held).read_bytes() if isinstance(held, str) else held.value
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digest(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    text = c.decode(ids).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode_texts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", long: int = LONG, finish: Callable | None = None, fields: str = "n_tokens bigint, ids_sha256 string, decoded_sha256 string") -> DataFrame:
    """One row of (doc_id, *fields) for every row: what ``finish(codec, ids)`` gives for a text's ids.

    Null texts are empty. Repeated rows each give a row, null ids stay null, other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    finish = finish or _digest
    # executors need no file: the vocabulary, a few MB, goes with the tasks
    held = spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split(" ")[1]] for x in fields.split(", ")]

    def whole(part: pa.RecordBatch) -> list:
        c = codec(held)
        done = [finish(c, c.encode(t)) for t in part.column(part.num_columns - 1).to_pylist()]
        return [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]

    short = map_text(rows.where(F.length("text") <= long), {"doc_id": F.col("doc_id")}, "text", fields, whole)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf or special id of each text."""
        c = codec(held)
        for batch in batches:
            for r, t in enumerate(batch.column(1).to_pylist()):
                n = 0
                for p, part in enumerate(c.parts(t)):
                    own = [""] if isinstance(part, int) else leaves(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column(0)[r], len(own)), pa.repeat(batch.column(2)[r], len(own)), pa.array(np.arange(n, n + len(own), dtype=np.int64)), pa.array([p] * len(own), pa.int64()),
                         pa.array([part if isinstance(part, int) else -1] * len(own), pa.int64()), pa.array(own, pa.string())],
                        names=["doc_id", "th", "leaf", "part", "special", "text"],
                    )
                    n += len(own)

    def ids_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held)
        for batch in batches:
            special, texts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ids = [c.leaf(t).astype("<u4").tobytes() if s < 0 else b"" for s, t in zip(special, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())], names=["doc_id", "th", "leaf", "part", "special", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        """All leaves of one id and text; a text that occurs in several rows has each leaf as often."""
        c = codec(held)
        at = {}
        copies: dict[int, int] = {}
        for leaf, part, special, ids in zip(*[table[k].to_pylist() for k in ("leaf", "part", "special", "ids")]):
            at[leaf] = (part, special, ids)
            copies[leaf] = copies.get(leaf, 0) + 1
        parts: dict[int, list] = {}
        for leaf in sorted(at):
            part, special, ids = at[leaf]
            parts.setdefault(part, []).append(special if special >= 0 else np.frombuffer(ids, "<u4"))
        done = [np.array(x, dtype=np.uint32) if isinstance(x[0], int) else c.tree(x) for _, x in sorted(parts.items())]
        row = finish(c, np.concatenate(done))
        n = max(copies.values())
        head = pa.repeat(table["doc_id"].combine_chunks()[0], n)
        return pa.Table.from_arrays([head, *[pa.array([v] * n, k) for v, k in zip(row, kinds)]], names=names)

    far = rows.where(F.length("text") > long).mapInArrow(cut, f"doc_id {id_type}, th bigint, leaf bigint, part bigint, special bigint, text string")
    encoded = far.repartition("th", "leaf").mapInArrow(ids_of, f"doc_id {id_type}, th bigint, leaf bigint, part bigint, special bigint, ids binary")
    return short.unionByName(encoded.groupBy("doc_id", "th").applyInArrow(joined, schema))


def round_trip(docs: DataFrame, path: str | None = None, **named) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode_texts(docs, path, **named)


def encode_column(docs: DataFrame, path: str | None = None, **named) -> DataFrame:
    """(doc_id, ids) of every row."""
    return encode_texts(docs, path, finish=_ids, fields="ids array<int>", **named)


def _ids(c: Codec, ids: np.ndarray) -> tuple:
    return (ids.astype(np.int32),)
