"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every benchmark item becomes windows of ten consecutive words (a shorter item is one window). A window can only
occur where each of its shingles occurs, so one shingle, its rarest over the whole corpus, is enough to find all
candidates. A candidate place must leave room for the window on both sides (positional and length bounds), and
then the window's words are compared one by one.

Null and empty texts have no words. Repeated rows each get their own result. An empty benchmark hits nothing.
Items without an id count for hits but are not listed.

Tasks hold windows by number only. Which items a window is of stays in a table: documents that hold the same windows
share one list of items, made once for each such set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalumen.llm.common import LOWERED, Sequences, documents, key, slices
from datalumen.session import checkpointed

WINDOW = 10
SHINGLE = 5
#: Windows held by a task at once; a larger benchmark is gone through in blocks of this many.
BLOCK_ROWS = 500_000
_FILTER_BITS = 22


def _shingle(n: int) -> int:
    return min(SHINGLE, n)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, window, size, shingles``: the distinct windows of each item with their shingle hashes in order."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            words = texts.words(LOWERED)
            runs = Sequences(words.hashes(), 1)
            code = words.code.tobytes()
            ids = texts.rows.column("item_id").to_pylist()
            rows: dict[tuple, tuple] = {}
            for i in range(len(texts)):
                low, high = words.first[i], words.first[i + 1]
                size = min(WINDOW, int(high - low))
                for s in range(low, high - size + 1) if size else ():
                    text = b" ".join(code[words.start[w]:words.stop[w]] for w in range(s, s + size)).decode()
                    at = np.arange(s, s + size - _shingle(size) + 1)
                    rows[ids[i], text] = (size, runs.of(at, at + _shingle(size)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
                pa.array([v[0] for v in rows.values()], pa.int32()),
                pa.array([v[1] for v in rows.values()], pa.list_(pa.int64()))],
                names=["item_id", "window", "size", "shingles"])

    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    return items.mapInArrow(windows, "item_id string, window string, size int, shingles array<bigint>").distinct()


class _Known:
    """A set of shingle hashes with a bitmap of fixed size before it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[found >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(self.hashes):
            return at[:0]
        near = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == found[at]]


def _shingles(words, runs: Sequences, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all shingles of ``size`` words that lie in one text."""
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(len(words)) + size <= last)
    return at, runs.of(at, at + size)


def shingle_counts(docs: DataFrame, shingles: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``shingle, n``: how often each of the given ``shingle, size`` occurs in all documents."""
    out = None
    for block in _blocks(shingles, "shingle", limit):
        rows = block.collect()
        known = {size: _Known(np.unique(np.array([r.shingle for r in rows if r["size"] == size], dtype=np.int64).view(np.uint64)))
                 for size in {r["size"] for r in rows}}

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for texts in slices(batches):
                words = texts.words(LOWERED)
                runs = Sequences(words.hashes(), 1)
                for size, these in known.items():
                    _, found = _shingles(words, runs, size)
                    values, n = np.unique(found[these.places(found)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        part = docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
        out = part if out is None else out.union(part)
    return out


def _blocks(df: DataFrame, by: str, limit: int) -> list[DataFrame]:
    """The rows in parts of about ``limit`` rows, by the hash of a column."""
    parts = max(1, -(-df.count() // limit))
    return [df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == i) if parts > 1 else df for i in range(parts)]


def prefixes(docs: DataFrame, windows: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``window, number, size, shingle, place``: each window with its rarest shingle and where in the window that stands."""
    by_window = checkpointed(windows.groupBy("window").agg(
        F.first("size").alias("size"), F.first("shingles").alias("shingles")).withColumn("number", F.monotonically_increasing_id()))
    each = by_window.select("window", "size", F.posexplode("shingles").alias("place", "shingle"))
    counts = shingle_counts(docs, each.select("shingle", F.least("size", F.lit(SHINGLE)).alias("size")).distinct(), limit)
    rarest = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    first = each.join(counts, "shingle", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1")
    return checkpointed(first.select("window", "shingle", "place").join(by_window.select("window", "size", "number"), "window"))


class Index:
    """One block of windows by prefix shingle, as a task uses it."""

    def __init__(self, rows: list):
        self.sizes: dict[int, tuple[_Known, dict[int, list]]] = {}
        grouped: dict[int, dict[int, list]] = {}
        for r in rows:
            entry = (r.place, r["size"], r.window.encode(), r.number)
            grouped.setdefault(_shingle(r["size"]), {}).setdefault(r.shingle % 2**64, []).append(entry)
        for size, by in grouped.items():
            self.sizes[size] = (_Known(np.array(sorted(by), dtype=np.uint64)), by)

    def matches(self, texts) -> tuple[object, dict[int, list[tuple[int, int, int]]]]:
        """The words of the texts, and per text with any: ``(first word, end, number)`` of each occurring window."""
        words = texts.words(LOWERED)
        runs = Sequences(words.hashes(), 1)
        code, text_of, out = words.code.tobytes(), words.text_of(), {}
        for size, (known, by) in self.sizes.items():
            at, found = _shingles(words, runs, size)
            for p in known.places(found).tolist():
                i = int(text_of[at[p]])
                low, high = int(words.first[i]), int(words.first[i + 1])
                for place, n, window, number in by[int(found[p])]:
                    start = int(at[p]) - place
                    if start < low or start + n > high:
                        continue
                    if b" ".join([code[words.start[w]:words.stop[w]] for w in range(start, start + n)]) == window:
                        out.setdefault(i, []).append((start - low, start - low + n, number))
        return words, out


def find_windows(docs: DataFrame, first: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_words, spans, numbers`` of every document: word spans of the windows ``first`` and their numbers, sorted."""
    docs = documents(docs)
    blocks = _blocks(first, "window", limit)
    out = None
    for block in blocks:
        index = docs.sparkSession.sparkContext.broadcast(Index(block.collect()))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for texts in slices(batches):
                words, found = index.value.matches(texts)
                hits = [found.get(i, ()) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([
                    texts.rows.column("doc_id"), texts.rows.column("row_key"), pa.array(np.diff(words.first)),
                    pa.array([[{"start": a, "stop": b} for a, b in sorted({x[:2] for x in h})] for h in hits],
                             pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([sorted({x[2] for x in h}) for h in hits], pa.list_(pa.int64()))],
                    names=["doc_id", "row_key", "n_words", "spans", "numbers"])

        part = key(docs).mapInArrow(find, "doc_id bigint, row_key bigint, n_words bigint, "
                                          "spans array<struct<start:int,stop:int>>, numbers array<bigint>")
        out = part if out is None else out.union(part)
    if len(blocks) > 1:  # each row came once from every block
        merged = out.groupBy("doc_id", "row_key", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"),
            (F.count("*") / len(blocks)).cast("int").alias("copies"))
        out = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", "spans", "numbers")


def _with_items(docs: DataFrame, benchmark: DataFrame, limit: int, facts: dict[str, Column]) -> DataFrame:
    """``doc_id, n_words, spans`` and facts of ``items``, the sorted ids of the items whose windows occur."""
    windows = checkpointed(benchmark_windows(benchmark))
    first = prefixes(documents(docs), windows, limit)
    found = checkpointed(find_windows(docs, first, limit))
    owners = windows.where("item_id IS NOT NULL").join(first.select("window", "number"), "window").select("number", "item_id")
    sets = found.where("size(numbers) > 0").select("numbers").distinct()
    listed = sets.withColumn("number", F.explode("numbers")).join(owners, "number").groupBy("numbers").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    hit = found.where("size(numbers) > 0").join(listed, "numbers", "left").withColumn("items", F.coalesce("items", none))
    both = hit.unionByName(found.where("size(numbers) = 0").withColumn("items", none))
    return both.select("doc_id", "n_words", "spans", *[fact.alias(name) for name, fact in facts.items()])


def find_passages(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document: word spans of benchmark windows, and the items they are of."""
    return _with_items(docs, benchmark, limit, {"items": F.col("items")})


def covered(spans: str) -> Column:
    """How many places the sorted half-open spans cover together."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["upto"], s["stop"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """Per document how many words are hit and which items occur."""
    found = _with_items(docs, benchmark, limit, {
        "n_items": F.size("items").cast("bigint"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return found.select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), "n_items", "items_sha256", (F.size("spans") > 0).alias("contaminated"))


def without_passages(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    out = docs
    for block in _blocks(prefixes(documents(docs), benchmark_windows(benchmark), limit), "window", limit):
        index = docs.sparkSession.sparkContext.broadcast(Index(block.collect()))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for texts in slices(batches):
                _, found = index.value.matches(texts)
                yield texts.rows.filter(pa.array([i not in found for i in range(len(texts))]))

        out = out.mapInArrow(clean, docs.schema)
    return out
