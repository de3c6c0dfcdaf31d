"""Packing documents into sequences of fixed length by length patterns, fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver. Lengths are rounded up to a grid; all
patterns of at most three grid lengths that fill a sequence are enumerated, and non-negative least squares finds how
often each is to be used for the histogram. The rounded counts are given exact lengths, and what is left goes by
best fit, longest first, into the gaps of the patterns and then into new sequences; all of that works on
counts per length, so the work does not grow with the corpus. The plan is a list of layouts (lengths side by side, and
how often), bounded by the number of lengths. Each piece gets its number among the pieces of its length (numbered in
salted groups, so that a frequent length is not one group) and from that its sequence and offset.

Null and empty texts are the closing id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalumen.llm.common import SLICE_BYTES, Sequences, Texts, documents, slices
from datalumen.session import checkpointed

SIZE = 2048
CLOSING = 0
_GRID = 128
_GROUPS = 1024
_CACHED_WORDS = 500_000

# -- tokens ---------------------------------------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_KIND = np.full(256, _UNKNOWN, dtype=np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _UNKNOWN  # contractions
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Encoder:
    """Ids of texts by a word BPE file, equal to its tokenizer's.

    Words of plain and Latin-1 letters, digits and signs are cut out as arrays and each new word goes through the BPE model once; any
    other text (apostrophes, other scripts, control characters, what may be a special token) goes through the tokenizer as a whole,
    and so does one with a word that shares its hash with another word of the slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = {t["content"].encode()[:2] for t in json.loads(self.whole.to_str())["added_tokens"]}
        self.special = [(t[0], t[-1]) for t in sorted(special)]
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        letters = _byte_letters()
        self.letters = {i: letters[i] for i in range(256)}

    def _word(self, word: bytes) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])
        ids = ids.tobytes()
        if len(self.known) >= _CACHED_WORDS:
            self.known.clear()
        self.known[word] = ids
        return ids

    def encode(self, texts: Texts) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        data, bounds = texts.data, texts.bounds
        lead = data == 0xC3
        after = np.zeros(len(data), dtype=bool)
        after[1:] = lead[:-1]
        accent = after & (data != 0x97) & (data != 0xB7)
        kind = _KIND[data]
        kind[accent] = _LETTER
        kind[:-1][accent[1:]] = _LETTER
        for one, two in self.special:
            kind[:-1][(data[:-1] == one) & (data[1:] == two)] = _UNKNOWN
        odd = np.concatenate(([0], np.cumsum(kind == _UNKNOWN)))
        plain = np.diff(odd[bounds]) == 0
        low = _LOWER[data]
        low[accent & (data < 0x9F)] += 32

        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | _at(bounds, len(data))[1:]
        ends = kind != _SPACE
        ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _DIGIT) | _at(bounds, len(data))[1:]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, bounds)
        if len(start):
            hashes = Sequences(low.astype(np.uint64) + np.uint64(1), 0).of(start, stop)
            _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            text_of = np.repeat(np.arange(len(texts)), np.diff(first))
            plain[text_of[_unlike(low, start, stop, one[which])]] = False
            raw, known = low.tobytes(), self.known
            use = np.zeros(len(one), dtype=bool)
            use[which[plain[text_of]]] = True  # words of other texts may be cut wrongly
            made = []
            for s, e, u in zip(start[one].tolist(), stop[one].tolist(), use.tolist()):
                word = raw[s:e]
                ids = known.get(word) if u else b""
                made.append(self._word(word) if ids is None else ids)
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
            flat, base = np.frombuffer(b"".join(made), dtype="<u4"), np.cumsum(sizes) - sizes
            n = sizes[which]
            total = np.concatenate(([0], np.cumsum(n)))
            ids = flat[np.repeat(base[which] - total[:-1], n) + np.arange(total[-1])].tobytes()
            cut = (total[first] * 4).tolist()
        else:
            ids, cut = b"", [0] * (len(texts) + 1)
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        for i in np.flatnonzero(~plain).tolist():
            encoded = self.whole.encode_batch_fast([texts.raw(i).decode()], add_special_tokens=False)[0]
            out[i] = np.array(encoded.ids, dtype="<u4").tobytes()
        return out


def _unlike(data: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans differ from the span whose number is given beside them."""
    size = stop - start
    apart = size != size[other]
    size = np.where(apart, 0, size)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    wrong = data[within + np.repeat(start, size)] != data[within + np.repeat(start[other], size)]
    apart[np.repeat(np.arange(len(size)), size)[wrong]] = True
    return np.flatnonzero(apart)


def _at(bounds: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    return edge[:n]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): the closed documents, only longer ones cut."""
    closing = np.array([CLOSING], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for texts in slices(batches, limit=4 * SLICE_BYTES):
            rows = [(i, k, cut) for i, ids in enumerate(encode(texts)) for k, cut in enumerate(_cut(ids + closing, 4 * size))]
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[1] for r in rows], pa.int32()), pa.array([r[1] * size for r in rows], pa.int64()),
                pa.array([len(r[2]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                *([pa.array([np.frombuffer(r[2], dtype="<i4") for r in rows], pa.list_(pa.int32()))] if with_ids else [])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return documents(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
                                      + (", ids array<int>" if with_ids else ""))


def _cut(ids: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(ids), size):
        yield ids[at:at + size]


# -- the plan -------------------------------------------------------------------------------------------------------


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x >= 0`` that minimises ``|a x - b|``, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * scale:
            break
        active[best] = True
        while True:
            solved = np.zeros_like(x)
            solved[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            under = active & (solved <= 0)
            if not under.any():
                x = solved
                break
            step = np.min(x[under] / np.maximum(x[under] - solved[under], 1e-300))
            x = x + step * (solved - x)
            x[~active] = 0
            active &= x > 1e-9 * scale
            x[~active] = 0
    return x


def patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most three parts, largest first."""
    return [(units,)] + [(a, units - a) for a in range(units - 1, (units - 1) // 2, -1)] + [
        (a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1)
        if 1 <= units - a - b <= b]


@dataclass
class Layout:
    lengths: tuple[int, ...]
    repeats: int


def plan(histogram: dict[int, int], size: int = SIZE, grid: int = _GRID) -> list[Layout]:
    """Layouts that use every length exactly as often as the histogram says."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    unit = -(-size // grid)
    units = size // unit
    shapes = patterns(units)
    a = np.zeros((units, len(shapes)))
    for k, parts in enumerate(shapes):
        for p in parts:
            a[p - 1, k] += 1
    coarse = np.zeros(units)
    for length in np.flatnonzero(left):
        coarse[min(-(-length // unit), units) - 1] += left[length]
    layouts: list[Layout] = []
    if coarse.any():
        repeats = np.floor(nonnegative_least_squares(a, coarse) + 0.5).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] > 0:
                layouts += _with_lengths(shapes[k], int(repeats[k]), left, unit, size)
    return _best_fit(layouts, left, size)


def _with_lengths(parts: tuple[int, ...], repeats: int, left: np.ndarray, unit: int, size: int) -> Iterator[Layout]:
    """The pattern with exact lengths, as often as they last; takes them from ``left``.

    The longest of each part are used first, and the last part may exceed its grid length where that leaves less room.
    """
    while repeats > 0:
        taken: list[int] = []
        for k, p in enumerate(parts):
            most = size - sum(taken) if k == len(parts) - 1 else min(p * unit, size)
            for length in range(most, (p - 1) * unit, -1):
                if left[length] > taken.count(length):
                    taken.append(length)
                    break
            else:
                return
        if sum(taken) > size:
            return
        n = min(repeats, *[int(left[x]) // taken.count(x) for x in taken])
        for x in taken:
            left[x] -= n
        repeats -= n
        yield Layout(tuple(taken), n)


def _best_fit(layouts: list[Layout], left: np.ndarray, size: int) -> list[Layout]:
    """Add the remaining lengths, longest first, each where the least room stays."""
    room: list[list[Layout]] = [[] for _ in range(size + 1)]
    for x in layouts:
        room[size - sum(x.lengths)].append(x)
    for length in range(size, 0, -1):
        need, gap = int(left[length]), length
        while need:
            while gap <= size and not room[gap]:
                gap += 1
            if gap > size:
                many = size // length
                for count, n in ((many, need // many), (need % many, 1)):
                    if count and n:
                        room[size - count * length].append(Layout((length,) * count, n))
                break
            x = room[gap].pop()
            n = min(need, x.repeats)
            if n < x.repeats:
                room[gap].append(Layout(x.lengths, x.repeats - n))
            room[gap - length].append(Layout((*x.lengths, length), n))
            need -= n
        left[length] = 0
    return [x for xs in room for x in xs]


class Places:
    """Where the ``k``-th piece of each length goes."""

    def __init__(self, layouts: list[Layout]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for x in layouts:
            at = 0
            for length in x.lengths:
                rows.setdefault(length, []).append((x.repeats, base, at))
                at += length
            base += x.repeats
        self.sequences = base
        self.by = {}
        for length, parts in rows.items():
            n, first, at = (np.array(c, dtype=np.int64) for c in zip(*parts))
            self.by[length] = (np.concatenate(([0], np.cumsum(n))), first, at)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            these = length == x
            upto, first, at = self.by[x]
            k = np.searchsorted(upto, rank[these], side="right") - 1
            sequence[these], offset[these] = first[k] + rank[these] - upto[k], at[k]
        return sequence, offset


# -- packing --------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    cut = checkpointed(pieces(docs, path, size, with_ids).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_GROUPS))))
    counts = checkpointed(cut.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, size)))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [c for c in cut.columns if c != "_salt"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
                             + (", ids array<int>" if with_ids else "") + ", sequence_id bigint, offset bigint")
