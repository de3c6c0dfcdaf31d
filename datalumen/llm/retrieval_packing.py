"""Packing of documents with their lexical neighbours: a sharded BM25 index over token ids fills the window of each seed.

Texts are tokenized once, cut into whole windows and a rest, and written to the shared folder. A whole window is a sequence and moves no
more. A rest has its document's signature: the signs of the summed weights of its ids along random directions; a later id of the
vocabulary is a rarer one and weighs more. Rests are range-partitioned by signature and row number, so that a task holds documents that
are alike, a group of copies is split like any other rows, and no key is hot. Frequencies of all ids (at most one number for
each entry of the vocabulary) are counted over all windows and rests.

A task goes through its rests in shards of bounded size. They enter the shard's inverted index (postings by id, with BM25 weights). Seeds are taken in order; the index returns the
unused documents by score, and they fill the seed's window greedily. The one that does not fit is cut, and its rest stays unused. So every
window is full. What cannot fill one goes on to the next shard; at the end of a task the last rest is cut into sequences
whose lengths are powers of two, which need no padding.

Null and empty texts are the closing id alone. Repeated rows are packed each. Rows without a doc_id keep null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import SLICE_BYTES, documents, slices, small_batches
from datalumen.llm.packing import encoder
from datalumen.session import scratch_path

SIZE, CLOSING = 2048, 1
# Usual BM25 constants; tokens of a shard and of a task; bits of a signature.
K1, B = 1.5, 0.75
SHARD_TOKENS, TASK_TOKENS, BITS = 1 << 19, 1 << 22, 16
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _directions(entries: int) -> np.ndarray:
    """For each id its weight along each direction; the same in every process."""
    signs = np.random.default_rng(13).integers(0, 2, (entries, BITS)) * 2 - 1
    return (signs * np.log2(2.0 + np.arange(entries))[:, None] ** 2).astype(np.float32)


def tokenized(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    """``doc_id, start, doc_tokens, ids, ids_crc32, signature``: whole windows, and the rest of each document without a checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        entries = max(known.whole.get_vocab_size(), closing + 1)
        kind, along = np.min_scalar_type(entries - 1), _directions(entries)
        end = np.array([closing], dtype="<u4").tobytes()
        for texts in slices(batches, limit=4 * SLICE_BYTES):
            rows: list[tuple] = []
            for i, raw in enumerate(known.encode(texts)):
                own, whole = np.frombuffer(raw, dtype="<u4"), raw + end
                bits = np.ones(len(own), dtype=np.float32) @ along.take(own, axis=0) > 0
                signature, total = int(np.packbits(bits).view(">u2")[0]), len(own) + 1
                ids = np.frombuffer(whole, dtype="<u4").astype(kind)
                for at in range(0, total, size):
                    full = at + size <= total
                    rows.append((i, at, total, ids[at:at + size].tobytes(), zlib.crc32(whole[4 * at:4 * (at + size)]) if full else None, signature))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:3]],
                pa.array(columns[3], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[4:]]],
                names=["doc_id", "start", "doc_tokens", "ids", "ids_crc32", "signature"])

    return documents(docs).mapInArrow(
        run, "doc_id bigint, start bigint, doc_tokens bigint, ids binary, ids_crc32 bigint, signature bigint")


def _kind(path: str, closing: int) -> tuple[int, np.dtype]:
    entries = max(encoder(path).whole.get_vocab_size(), closing + 1)
    return entries, np.min_scalar_type(entries - 1)


def frequencies(rows: DataFrame, entries: int, kind: np.dtype) -> tuple[np.ndarray, int, int]:
    """How many rows hold each id, how many rows and tokens there are; at most ``entries`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, tokens = np.zeros(entries, dtype=np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("ids")
            sizes = pc.binary_length(cells).to_numpy() // kind.itemsize
            ids = np.frombuffer(b"".join(cells.to_pylist()), dtype=kind)
            # Each id of a row once.
            key = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes) | ids)
            first = np.ones(len(key), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            held += np.bincount(key[first] & 0xFFFFFFFF, minlength=entries)
            tokens += len(ids)
            docs += batch.num_rows
        ids = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, [-1, -2])), pa.array(np.append(held[ids], [docs, tokens]))], names=["id", "n"])

    found = np.zeros(entries + 2, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        found[r["id"]] = r["n"]
    return found[:entries], int(found[-1]), int(found[-2])


class Part:
    """What is left of one document: its ids from ``start`` on."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def take(self, n: int) -> Part:
        """The first ``n`` ids, cut off."""
        out = Part(self.doc, self.ids[:n], self.start, self.total)
        self.ids, self.start = self.ids[n:], self.start + n
        return out


class Index:
    """Inverted index of some parts: postings by id, with BM25 weights."""

    def __init__(self, parts: list[Part], idf: np.ndarray, average: float):
        size = np.array([len(p.ids) for p in parts])
        key = np.concatenate([p.ids for p in parts]).astype(np.int64) * len(parts) + np.repeat(np.arange(len(parts)), size)
        key, times = np.unique(key, return_counts=True)
        term, self.part = np.divmod(key, len(parts))
        norm = K1 * (1 - B + B * size / average)
        self.weight = idf[term] * times * (K1 + 1) / (times + norm[self.part])
        self.term, self.parts, self.entries = term, len(parts), len(idf)
        self._bound()

    def _bound(self) -> None:
        self.first = np.searchsorted(self.term, np.arange(self.entries + 1))

    def keep(self, alive: np.ndarray) -> None:
        """Leave out the postings of used parts."""
        held = alive[self.part]
        self.term, self.part, self.weight = self.term[held], self.part[held], self.weight[held]
        self._bound()

    def ranked(self, ids: np.ndarray) -> np.ndarray:
        """All parts, best first; ties in order."""
        ids = np.sort(ids)
        ids = ids[np.concatenate(([True], ids[1:] != ids[:-1]))]
        low, n = self.first[ids], self.first[ids + 1] - self.first[ids]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.argsort(-np.bincount(self.part[at], self.weight[at], self.parts), kind="stable")


def windows(parts: list[Part], idf: np.ndarray, average: float, size: int) -> Iterator[list[Part]]:
    """Full windows of a seed and its unused neighbours; what is left at the end is one shorter window."""
    index = Index(parts, idf, average)
    alive = np.ones(len(parts), dtype=bool)
    left, total = len(parts), sum(len(p.ids) for p in parts)
    for seed in range(len(parts)):
        if not alive[seed]:
            continue
        if total <= size:
            yield [p for p, a in zip(parts, alive) if a]
            return
        if 2 * alive.sum() < left:
            left = int(alive.sum())
            index.keep(alive)
        window, room = [parts[seed]], size - len(parts[seed].ids)
        ranked = index.ranked(parts[seed].ids)
        alive[seed] = False
        for k in ranked[alive[ranked]]:
            if not room:
                break
            if len(parts[k].ids) <= room:
                alive[k] = False
                window.append(parts[k])
            else:
                window.append(parts[k].take(room))
            room -= len(window[-1].ids)
        total -= size
        yield window


def _powers(parts: list[Part]) -> Iterator[list[Part]]:
    """Sequences whose lengths are powers of two, longest first."""
    total, at = sum(len(p.ids) for p in parts), 0
    while total:
        room, window = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            if len(parts[at].ids) <= room:
                window.append(parts[at])
                at += 1
            else:
                window.append(parts[at].take(room))
            room -= len(window[-1].ids)
        yield window


def pack(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING, shard: int = SHARD_TOKENS, task: int = TASK_TOKENS,
         with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``) of every piece.

    ``shard`` is how many tokens an index holds, ``task`` how many a task is meant to go through.
    """
    spark = docs.sparkSession
    entries, kind = _kind(path, closing)
    where = scratch_path(spark, "tokenized")
    tokenized(docs, path, size, closing).withColumn("row", F.monotonically_increasing_id()).write.option(
        "compression", "zstd").option("parquet.enable.dictionary", "false").parquet(where)
    rows = spark.read.parquet(where)
    held, n, tokens = frequencies(rows, entries, kind)
    known = spark.sparkContext.broadcast(np.log1p((n - held + 0.5) / (held + 0.5)))
    average = max(1.0, tokens / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 40, 0
        out: list[tuple] = []

        def put(window: list[Part]) -> None:
            nonlocal made
            offset = 0
            for p in window:
                ids = p.ids.astype("<u4")
                out.append((p.doc, p.start, len(ids), zlib.crc32(ids.tobytes()), p.total, first + made, offset, *([ids.view("<i4")] if with_ids else [])))
                offset += len(ids)
            made += 1

        def rows_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * (len(_NAMES) + with_ids)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:len(_NAMES)]] + ([pa.array(columns[-1], pa.list_(pa.int32()))] if with_ids else []),
                names=[*_NAMES, *(["ids"] if with_ids else [])])

        waiting: list[Part] = []
        waits = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, waits
            rest = []
            for window in windows(waiting, known.value, average, size) if waiting else ():
                if sum(len(p.ids) for p in window) < size:
                    rest = window
                else:
                    put(window)
                if len(out) >= 10_000:
                    yield rows_of()
            waiting, waits = rest, sum(len(p.ids) for p in rest)
            if last:
                for window in _powers(waiting):
                    put(window)
            yield rows_of()

        for batch in batches:
            for doc, start, total, cell in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), batch.column("ids")):
                waiting.append(Part(doc, np.frombuffer(cell.as_py(), dtype=kind), start, total))
                waits += len(waiting[-1].ids)
                if waits >= shard:
                    yield from flush(False)
        yield from flush(True)

    small_batches(docs)
    more = ["ids"] if with_ids else []
    rests = rows.where("ids_crc32 IS NULL").select("doc_id", "start", "doc_tokens", "ids", "signature", "row")
    dealt = rests.repartitionByRange(max(1, -(-tokens // task)), "signature", "row").sortWithinPartitions("signature", "row")
    packed = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, _SCHEMA + (", ids array<int>" if with_ids else ""))
    # A whole window is a sequence of its own; their numbers are negative.
    whole = rows.where("ids_crc32 IS NOT NULL").select(
        "doc_id", "start", F.lit(size).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), *more)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(x.as_buffer(), dtype=kind).astype("<i4") for x in batch.column("ids")], pa.list_(pa.int32()))
            yield batch.set_column(batch.num_columns - 1, "ids", ids)

    return packed.unionByName(whole.mapInArrow(opened, _SCHEMA + ", ids array<int>") if with_ids else whole)
