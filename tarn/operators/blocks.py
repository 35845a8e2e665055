"""Blocks of postings: what a token has in one range of documents, packed, and the search of one range's blocks.

A range is a few hundred documents that one task indexed one after the other; a document's number in it is its place. A block has the numbers of the documents with the token, how
often each has it and where. The greatest count and the least document length of a block bound the score of its documents from above without a look at them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents and tokens up to which a range takes more documents.
RANGE, RANGE_TOKENS = 512, 2_000_000
BLOCK = "token string, range bigint, n int, max_tf int, min_dl int, ords binary, tfs binary, places binary"


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each run of values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def trigram_codes(texts: pa.Array) -> np.ndarray:
    """All runs of three code points of each text, one integer of 63 bits each; shorter texts have none."""
    own = texts.to_pylist()
    chars = np.frombuffer("".join(own).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    if len(chars) < 3:
        return np.zeros(0, dtype=np.int64)
    codes = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    # runs that begin at a text's last two characters reach into the next text
    keep, ends = np.ones(len(chars), dtype=bool), np.cumsum(size)
    keep[np.maximum(ends[size > 0] - 1, 0)] = False
    keep[ends[size > 1] - 2] = False
    return codes[keep[:-2]]


def trigram_texts(codes: np.ndarray) -> pa.Array:
    """The strings of some codes."""
    chars = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    whole = chars.tobytes().decode("utf-32-le")
    return pa.array([whole[i : i + 3] for i in range(0, len(whole), 3)], pa.string())


def in_order(code: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Places of the rows by code, then document, then as they came."""
    if len(ord_) and (np.diff(ord_) < 0).any():  # several fields: a batch's fields follow each other
        base = np.argsort(ord_, kind="stable")
        return base[in_order(code[base], ord_[base])]
    n = len(code)
    if n and int(code.max()) < (1 << 62) // n:  # a plain sort of one integer is the fastest
        return np.sort(code * n + np.arange(n)) % n
    return np.argsort(code, kind="stable")


def invert(batches: Iterable[pa.RecordBatch], n_fields: int, first: int, grams: bool = False) -> Iterator[pa.RecordBatch]:
    """From (key, tokens of each field): a row with the keys and lengths of each range, and one for each of its tokens. With ``grams`` from (key, text of each field), whose trigrams are the tokens.

    Places of a field go on behind those of the field before it with one place between, so no phrase reaches over both.
    """
    keys, lengths, tokens, ords, places, docs, held, number = [], [], [], [], [], 0, 0, first

    def done() -> Iterator[pa.RecordBatch]:
        own, dl = pa.concat_arrays(keys), np.concatenate(lengths)
        head = pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.array([number]), pa.array([len(own)], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([dl.tolist()], pa.list_(pa.int32()))],
            names=names,
        )
        yield head
        if not sum(map(len, tokens)):
            return
        if grams:
            raw = np.concatenate(tokens)
            seen = np.zeros(1 << 21, dtype=bool)  # characters are numbered, so that codes are small
            for shift in (42, 21, 0):
                seen[raw >> shift & 0x1FFFFF] = True
            number_of, n_chars = np.cumsum(seen) - 1, int(seen.sum())
            code = (number_of[raw >> 42] * n_chars + number_of[raw >> 21 & 0x1FFFFF]) * n_chars + number_of[raw & 0x1FFFFF]
            chars = np.flatnonzero(seen)
            dictionary = lambda c: trigram_texts(chars[c // n_chars // n_chars] << 42 | chars[c // n_chars % n_chars] << 21 | chars[c % n_chars])
        else:
            words = pa.chunked_array(tokens, pa.string()).combine_chunks().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            dictionary = lambda c: words.dictionary.take(pa.array(c))
        ord_, place = np.concatenate(ords), np.concatenate(places)
        order = in_order(code, ord_)  # places of a document and token are in order already
        code, ord_, place = code[order], ord_[order], place[order]
        start = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(ord_, prepend=-1) != 0))
        tf = np.diff(np.append(start, len(code)))
        doc = ord_[start]
        block = np.flatnonzero(np.diff(code[start], prepend=-1))
        ends, place_ends = np.append(block, len(start)), np.append(start[block], len(code))
        n = len(block)
        yield pa.RecordBatch.from_arrays(
            [dictionary(code[start[block]]), pa.array(np.full(n, number)), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.maximum.reduceat(tf, block).astype(np.int32)), pa.array(np.minimum.reduceat(dl[doc], block).astype(np.int32)),
             packed(doc.astype("<u2"), ends), packed(tf.astype("<u4"), ends), packed(place.astype("<u4"), place_ends), pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int32()))],
            names=names,
        )

    names = ["token", "range", "n", "max_tf", "min_dl", "ords", "tfs", "places", "keys", "dls"]
    kind = None
    for whole in batches:
        kind = pa.list_(whole.column(0).type)
        at = 0
        counts = [np.maximum(np.asarray(pc.utf8_length(c), dtype=np.int64) - 2, 0) if grams else np.asarray(c.value_lengths(), dtype=np.int64) for c in whole.columns[1:]]
        sizes = sum(counts)
        upto = np.cumsum(sizes)
        while at < whole.num_rows:
            # as many rows as the range has room for
            most = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + max(RANGE_TOKENS - held, 0), side="right"))
            end = min(max(most, at + (docs == 0)), at + RANGE - docs, whole.num_rows)
            if end > at:
                batch = whole.slice(at, end - at)
                offset = np.zeros(end - at, dtype=np.int64)
                for f, c in enumerate(batch.columns[1:]):
                    n = counts[f][at:end]
                    starts = np.cumsum(n) - n
                    tokens.append(trigram_codes(c) if grams else c.flatten())
                    ords.append(np.repeat(np.arange(docs, docs + len(n)), n))
                    places.append(np.arange(n.sum()) - np.repeat(starts - offset, n))
                    offset += n + 1
                keys.append(batch.column(0))
                lengths.append(sizes[at:end])
                docs, held, at = docs + end - at, held + int(sizes[at:end].sum()), end
            if docs >= RANGE or held >= RANGE_TOKENS or at < whole.num_rows:
                yield from done()
                keys, lengths, tokens, ords, places, docs, held, number = [], [], [], [], [], 0, 0, number + 1
    if docs:
        yield from done()


@dataclass
class Range:
    """The blocks of one range of a segment that a search has read."""

    segment: int
    number: int
    keys: pa.Scalar | None = None
    dl: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gone: list[int] = field(default_factory=list)
    items: list[int] = field(default_factory=list)
    raw: dict[str, tuple[bytes, bytes, bytes | None]] = field(default_factory=dict)
    _lists: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def block(self, token: str) -> tuple[np.ndarray, np.ndarray, bytes | None]:
        if token not in self.raw:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), b""
        ords, tfs, places = self.raw[token]
        return np.frombuffer(ords, "<u2").astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64), places

    def spots(self, token: str, offset: int, docs: np.ndarray) -> np.ndarray:
        """document << 32 | start of a phrase that has the token at ``offset``, in some documents."""
        ords, tfs, places = self.block(token)
        at = np.frombuffer(places, "<u4").astype(np.int64) - offset
        doc = np.repeat(ords, tfs)
        keep = np.isin(doc, docs) & (at >= 0)
        return doc[keep] << 32 | at[keep]

    def phrase(self, tokens: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, how often each has the phrase), without documents that are gone."""
        if tokens not in self._lists:
            if len(tokens) == 1:
                docs, f, _ = self.block(tokens[0])
            else:
                docs = self.block(tokens[0])[0]
                for t in set(tokens[1:]):
                    docs = np.intersect1d(docs, self.block(t)[0], assume_unique=True)
                spots = None
                for i, t in enumerate(tokens) if len(docs) else ():
                    own = self.spots(t, i, docs)
                    spots = own if spots is None else np.intersect1d(spots, own, assume_unique=True)
                docs, f = np.unique(spots >> 32, return_counts=True) if spots is not None else (docs, np.zeros(0, dtype=np.int64))
            if self.gone:
                keep = ~np.isin(docs, self.gone)
                docs, f = docs[keep], f[keep]
            self._lists[tokens] = docs, f
        return self._lists[tokens]


def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[Range]:
    """Ranges from rows (segment, range, part, token, n, ords, tfs, places, keys, dls) that are sorted so; part is 0 for the documents' row, 1 for one that is gone, 2 for an item that asks, 3 for a block."""
    now = None
    for batch in batches:
        segment, number, part, token, n, ords, tfs, places = (c.to_pylist() for c in batch.columns[:8])
        for i in range(batch.num_rows):
            if now is None or (segment[i], number[i]) != (now.segment, now.number):
                if now is not None:
                    yield now
                now = Range(segment[i], number[i])
            if part[i] == 0:
                now.keys, now.dl = batch.column(8).slice(i, 1).flatten(), np.asarray(batch.column(9).slice(i, 1).flatten(), dtype=np.float64)
            elif part[i] == 1:
                now.gone.append(n[i])
            elif part[i] == 2:
                now.items.append(n[i])
            else:
                now.raw[token[i]] = (ords[i], tfs[i], places[i])
    if now is not None:
        yield now


def merged(found: Iterable[Range], first: int) -> Iterator[pa.RecordBatch]:
    """Blocks of some ranges together, without the documents that are gone: ranges of a task are put together up to ``RANGE`` documents."""
    wait: list[tuple[pa.Array, np.ndarray, dict]] = []
    docs, number = 0, first

    def done() -> Iterator[pa.RecordBatch]:
        keys, dl = pa.concat_arrays([w[0] for w in wait]), np.concatenate([w[1] for w in wait])
        rows: dict[str, list[tuple]] = {}
        base = 0
        for own, _, lists in wait:
            for token, (ords, tfs, places) in lists.items():
                rows.setdefault(token, []).append((ords + base, tfs, places))
            base += len(own)
        joined = {t: tuple(np.concatenate(c) for c in zip(*parts)) for t, parts in rows.items()}
        n = len(joined)
        table = [
            [None, *joined], [number] * (n + 1), [len(keys), *(len(o) for o, _, _ in joined.values())], [None, *(int(f.max()) for _, f, _ in joined.values())], [None, *(int(dl[o].min()) for o, _, _ in joined.values())],
            [None, *(o.astype("<u2").tobytes() for o, _, _ in joined.values())], [None, *(f.astype("<u4").tobytes() for _, f, _ in joined.values())], [None, *(p.astype("<u4").tobytes() for _, _, p in joined.values())],
        ]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        head = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        lists = pa.concat_arrays([head, pa.nulls(n, head.type)]) if n else head
        sizes = pa.array([dl.astype(int).tolist(), *[None] * n], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(table, kinds)), lists, sizes], names=["token", "range", "n", "max_tf", "min_dl", "ords", "tfs", "places", "keys", "dls"])

    for r in found:
        keep = np.setdiff1d(np.arange(len(r.keys)), r.gone)
        if not len(keep):
            continue
        if docs + len(keep) > RANGE:
            yield from done()
            wait, docs, number = [], 0, number + 1
        place = np.full(len(r.keys), -1)
        place[keep] = np.arange(len(keep))
        lists = {}
        for token in r.raw:
            ords, tfs, places = r.block(token)
            stay = place[ords] >= 0
            if stay.any():
                lists[token] = place[ords[stay]], tfs[stay], np.frombuffer(places, "<u4")[np.repeat(stay, tfs)]
        wait.append((r.keys.take(pa.array(keep)), r.dl[keep], lists))
        docs += len(keep)
    if wait:
        yield from done()
