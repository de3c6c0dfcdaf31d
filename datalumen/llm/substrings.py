"""Passages of many words that an earlier document already has, found with suffix automata of reference shards.

A window is ``n`` consecutive words. Broadcasting automata of the whole corpus would send every document through every
shard, so the reference is cut down first and each document meets only the shards that can match it:

1. Every window selects the smallest of its word ``ANCHOR``-grams. Equal windows select equal anchors, so a window can
   only repeat where its anchor does. Consecutive windows with one anchor are a *block*; anchors in one document are dropped.
   A document's places of one block are kept as progressions, so a run of one word makes two rows however long it is.
2. Blocks that are equal as a whole need no comparison of words: all but those in the smallest document go. This covers
   the inside of passages and of copies, however many there are, by grouped minima.
3. What is left are the first holders of differing blocks around one anchor (the ends of passages, edited copies).
   Each anchor's blocks, each once per document, are a reference shard. In ascending order of documents, a block is streamed through the shard's suffix
   automaton for its matching statistics; words under a match of ``n`` or more go, and then the block joins the automaton.
   Shards are bounded by ``shard`` blocks; anchors with more of them compare their windows by hash, grouped in the same way.

Null and empty texts have no words; very long texts, also runs of one word, need memory for one text at a time. Rows with the same id never remove each other's words; rows without an id neither
remove nor lose words. Repeated rows each get their own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import PLAIN, Sequences, documents, key, marked, slices
from datalumen.session import checkpointed

WINDOW = 50
ANCHOR = 25
#: Blocks in one automaton.
SHARD = 64
#: Blocks of one document in an Arrow batch.
CUT_ROWS = 500
_POSITION = np.uint64((1 << 28) - 1)


def _window_blocks(words, n: int):
    """Blocks of the texts of a slice: text, anchor hash, block hash, first and last window start (from 0 in the text)."""
    anchor = max(1, n // 2) if n != WINDOW else ANCHOR
    hashes = words.hashes()
    runs, grams = Sequences(hashes, 1), Sequences(hashes, 2)
    total, width = len(words), n - anchor + 1
    if total < n:
        return hashes, None
    at = np.arange(total - anchor + 1)
    order = (grams.of(at, at + anchor) & ~_POSITION) | at.astype(np.uint64)
    least, have = order, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    chosen = (least & _POSITION).astype(np.int64)
    text_of = words.text_of()
    starts = np.flatnonzero(np.arange(total) + n <= words.first[1:][text_of])
    if not len(starts):
        return hashes, None
    pick, text = chosen[starts], text_of[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high = starts[first], starts[last]
    base = words.first[text[first]]
    return hashes, (text[first], grams.of(pick[first], pick[first] + anchor), runs.of(low, high + n), low - base, high - base)


def _progressions(text, anchor, block, low, high):
    """The same blocks, those of equal text, anchor and block at equal distances as one: the first one's place, the step and the count."""
    order = np.lexsort((low, block, anchor, text))
    text, anchor, block, low, high = (x[order] for x in (text, anchor, block, low, high))
    same = np.zeros(len(low), dtype=bool)
    same[1:] = (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1])
    step = np.where(same, np.diff(low, prepend=low[:1]), 0)
    goes_on = same.copy()
    goes_on[1:] &= step[1:] == step[:-1]
    first = np.flatnonzero(~goes_on)
    return *(x[first] for x in (text, anchor, block, low, high, step)), np.diff(np.append(first, len(low)))


def blocks(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``doc_id, row_key, anchor, block, low, high, step, times``: the blocks of every document with an id.

    ``low`` and ``high`` are the first and last window start of a block, which stands there ``times`` times, ``step`` words apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            _, found = _window_blocks(texts.words(PLAIN), n)
            if found is not None:
                text, anchor, block, low, high, step, times = _progressions(*found)
                rows = texts.rows.take(pa.array(text))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("row_key"), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)),
                    *[pa.array(x.astype(np.int32)) for x in (low, high, step, times)]],
                    names=["doc_id", "row_key", "anchor", "block", "low", "high", "step", "times"])

    return docs.where("doc_id is not null").mapInArrow(
        run, "doc_id bigint, row_key bigint, anchor bigint, block bigint, low int, high int, step int, times int")


class Automaton:
    """A suffix automaton over words that grows by whole texts; no match runs from one text into the next."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.ends = 0, 0

    def _add(self, c) -> None:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        self.last = cur

    def add(self, words: list) -> None:
        for c in words:
            self._add(c)
        self.ends += 1
        self._add(("end", self.ends))

    def matches(self, words: list) -> Iterator[int]:
        """For each place, the length of the longest run that ends there and occurs in the texts so far."""
        state = length = 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            yield length


def _spans(ends: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal spans of the windows of ``n`` words that end at the given ascending places."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and e - n + 1 <= out[-1][1]:
            out[-1] = (out[-1][0], e + 1)
        else:
            out.append((e - n + 1, e + 1))
    return out


def _shard_spans(rows: list[tuple[int, int, int, list]], n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``doc_id, row_key, block, start, stop`` of what blocks ``(doc_id, row_key, block, words)`` of one anchor repeat of smaller documents."""
    shard, waiting, of = Automaton(), [], None
    for doc, row, block, words in rows:
        if doc != of:
            for earlier in waiting:
                shard.add(earlier)
            waiting, of = [], doc
        waiting.append(words)
        for a, b in _spans([i for i, m in enumerate(shard.matches(words)) if m >= n], n):
            yield doc, row, block, a, b


_INSIDE = "anchor bigint, doc_id bigint, row_key bigint, block bigint, start int, stop int"


def _from_shards(opened: DataFrame, n: int) -> DataFrame:
    """Spans inside blocks by automata; the rows of an anchor come together, in order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(anchor, rows):
            found = [(anchor, *x) for x in _shard_spans(rows, n)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in found], schema=schema)

        schema = pa.schema([*[(c, pa.int64()) for c in ("anchor", "doc_id", "row_key", "block")], ("start", pa.int32()), ("stop", pa.int32())])
        anchor, rows = None, []
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc_id", "row_key", "block", "words")]):
                if r[0] != anchor:
                    if len(rows) > 1:
                        yield finished(anchor, rows)
                    anchor, rows = r[0], []
                rows.append(r[1:])
        if len(rows) > 1:
            yield finished(anchor, rows)

    placed = opened.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "block")
    return placed.mapInArrow(run, _INSIDE)


def _from_windows(opened: DataFrame, n: int) -> DataFrame:
    """The same spans by window hashes, for anchors of any number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) - n + 1 for x in batch.column("words").to_pylist()])
            words = batch.column("words").flatten().to_numpy().view(np.uint64)
            base = np.concatenate(([0], np.cumsum(sizes + n - 1)))[:-1]
            row = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = base[row] + inside
            found = Sequences(words, 0).of(at, at + n)
            yield pa.RecordBatch.from_arrays([
                *[pa.array(batch.column(c).to_numpy()[row]) for c in ("anchor", "doc_id", "row_key", "block")],
                pa.array(inside.astype(np.int32)), pa.array(found.view(np.int64))],
                names=["anchor", "doc_id", "row_key", "block", "start", "window"])

    windows = checkpointed(opened.mapInArrow(run, "anchor bigint, doc_id bigint, row_key bigint, block bigint, start int, window bigint"))
    first = checkpointed(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other"))
                         .where("holder < other").drop("other"))
    return windows.join(first, ["anchor", "window"]).where("doc_id > holder").select(
        "anchor", "doc_id", "row_key", "block", "start", (F.col("start") + n).alias("stop"))


def _everywhere(held: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``doc_id, row_key, start, stop`` of a span inside a block at all its places; places that touch each other are one span."""
    held = held.select("doc_id", "row_key", "step", "times", start.alias("start"), stop.alias("stop"))
    touching = F.col("step") <= F.col("stop") - F.col("start")
    places = F.when(touching, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("times") - 1))
    wide = F.when(touching, (F.col("times") - 1) * F.col("step")).otherwise(F.lit(0))
    return held.select("doc_id", "row_key", "start", "stop", "step", wide.alias("wide"), F.explode(places).alias("place")).select(
        "doc_id", "row_key", (F.col("start") + F.col("place") * F.col("step")).alias("start"),
        (F.col("stop") + F.col("place") * F.col("step") + F.col("wide")).alias("stop"))


def repeated_spans(packed: DataFrame, docs: DataFrame, n: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``doc_id, row_key, spans``: the word spans to remove of each document that has any."""
    found = blocks(docs, n)
    shared = checkpointed(found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                          .where("least < most").select("anchor"))
    held = checkpointed(found.join(shared, "anchor"))
    holders = held.groupBy("anchor", "block").agg(F.min("doc_id").alias("holder"))
    several = holders.groupBy("anchor").agg(F.count("*").alias("kinds"))
    holders = checkpointed(holders)
    several = checkpointed(several.where("kinds > 1"))
    known = checkpointed(held.join(holders, ["anchor", "block"]))
    whole = _everywhere(known.where("doc_id > holder"), F.col("low"), F.col("high") + n)
    opened = known.where("doc_id = holder").join(several, "anchor")
    once = opened.groupBy("doc_id", "row_key", "anchor", "block", "kinds").agg(F.min(F.struct("low", "high")).alias("at"))
    wanted = once.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("anchor", "block", "kinds", F.col("at.low"), F.col("at.high"))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in unpacked(batch):
                words = one.words(PLAIN)
                hashes = words.hashes().view(np.int64)
                doc, row = (one.rows.column(c)[0].as_py() for c in ("doc_id", "row_key"))
                parts = pa.RecordBatch.from_struct_array(one.rows.column("parts").flatten())
                for at in range(0, parts.num_rows, CUT_ROWS):
                    some = parts.slice(at, CUT_ROWS)
                    low, high = (some.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
                    ends = np.cumsum(high + n - low)
                    place = np.arange(ends[-1]) + np.repeat(high + n - ends, high + n - low)
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(hashes[place]))
                    yield pa.RecordBatch.from_arrays([
                        some.column("anchor"), some.column("kinds"), pa.array([doc] * len(low), pa.int64()),
                        pa.array([row] * len(low), pa.int64()), some.column("block"), own],
                        names=["anchor", "kinds", "doc_id", "row_key", "block", "words"])

    one_row_each = packed.join(checkpointed(wanted), ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"])
    parts = checkpointed(one_row_each.mapInArrow(
        cut, "anchor bigint, kinds bigint, doc_id bigint, row_key bigint, block bigint, words array<bigint>"))
    inside = _from_shards(parts.where(F.col("kinds") <= shard), n).union(_from_windows(parts.where(F.col("kinds") > shard), n))
    placed = known.where("doc_id = holder").join(inside, ["anchor", "doc_id", "row_key", "block"])
    spans = whole.union(_everywhere(placed, F.col("low") + F.col("start"), F.col("low") + F.col("stop")))
    return spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def pack(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, packed``: texts compressed, for the two joins that move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for texts in slices(batches):
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id"), texts.rows.column("row_key"),
                pa.array([squeeze.compress(texts.raw(i)) for i in range(len(texts))], pa.binary())], names=["doc_id", "row_key", "packed"])

    return docs.mapInArrow(run, "doc_id bigint, row_key bigint, packed binary")


def unpacked(batch: pa.RecordBatch) -> Iterator:
    """The texts of packed rows, one at a time."""
    for i in range(batch.num_rows):
        text = zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py())
        row = batch.slice(i, 1)
        yield next(slices(iter([row.append_column("text", pa.array([text], pa.large_binary()))])))


def remove_repeats(docs: DataFrame, n: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept``: every document's kept words joined by one space."""
    docs = key(documents(docs))
    packed = pack(docs)
    spans = checkpointed(repeated_spans(packed, docs, n, shard))
    return packed.join(spans, ["doc_id", "row_key"], "left").mapInArrow(
        _kept(True), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept string")


def repeat_digests(docs: DataFrame, n: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    docs = key(documents(docs))
    packed = pack(docs)
    spans = checkpointed(repeated_spans(packed, docs, n, shard))
    return packed.join(spans, ["doc_id", "row_key"], "left").mapInArrow(
        _kept(False), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _kept(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column("spans").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                words = zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py()).split()
                total, own = len(words), spans[i] or []
                if own:
                    gone = marked(total, np.array([s["start"] for s in own]), np.array([s["stop"] for s in own]))
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                rows.append((ids[i], total, total - len(words), own, kept))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                *([pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                   pa.array([r[4].decode() for r in rows], pa.string())] if full else
                  [pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())])],
                names=["doc_id", "n_words", "n_removed", *(["spans", "kept"] if full else ["kept_sha256"])])

    return run
