"""Alignment of two tokenizers over the same texts, on Arrow arrays.

Both tokenizations of a slice of documents are list arrays. Flattened, with their parent indices, entry lengths become
cumulative sums: the byte offsets at which tokens end. Every document has the same bytes under both, so the running sum over
the slice is the sum within the document plus a base that both share, and an end offset is a key of document and place. A full
outer hash join of both sides on these keys gives all ends. In order, each is the end of one stretch that one token of either side
covers: of its own where it ends there, else of the next that does. So the stretches are the links (overlapping tokens), and keys found on
both sides are the ends of groups.

Links of a document are grouped to distinct id pairs with their numbers and written to the shared folder, packed, with the rest
of its row, so that texts are tokenized once. Pairs are counted (documents that hold them) by ``group_by`` inside tasks and summed by Spark. The counts are
then looked up by each document: from a broadcast table while there are at most ``BROADCAST`` pairs, beyond that by a
join of the pairs of all documents with the counts, salted so that a frequent pair is no single key.

Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens and count nowhere. Very
long texts are handled alone; memory grows with the longest one. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import SLICE_BYTES, Texts, documents, slices
from datalumen.llm.packing import _byte_letters
from datalumen.session import checkpointed, scratch_path

#: Id pairs that a broadcast may hold, keys held by a task before they are grouped, parts of a frequent pair in the join.
BROADCAST, HELD, SALTS = 1 << 21, 1 << 22, 32
_PLAIN = 0xC9  # lead byte of U+0240 to U+027F; up to there both forms of the first tokenizer cut alike
_COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class Tokenizer:
    """Ids of texts, and the bytes of each id."""

    entries: list[bytes]

    def tables(self) -> None:
        self.bytes = pa.array(self.entries, pa.large_binary())
        self.lengths = pc.binary_length(self.bytes)
        self.kind = np.min_scalar_type(max(1, len(self.entries) - 1))

    def encode(self, texts: list[str]) -> list[np.ndarray] | list[list[int]]:
        raise NotImplementedError


class ByteBpe(Tokenizer):
    """A byte-level BPE file; texts of Latin letters go through its faster form with the same entries."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Whole

        self.whole = Whole.from_file(path)
        self.whole.encode_special_tokens = True
        special = {t["id"] for t in json.loads(self.whole.to_str())["added_tokens"]}
        byte = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.entries[i] = entry.encode() if i in special else bytes(byte[c] for c in entry)
        ranks = {self.entries[i]: i for i in vocabulary.values() if i not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tables()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if text.isascii() or max(text.encode()) <= _PLAIN:
                out.append(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()))
            else:
                out.append(np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32))
        return out


class Pieces(Tokenizer):
    """A piece model with byte fallback; it puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]
        self.tables()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple, tuple[ByteBpe, Pieces]] = {}


def tokenizers(first: str, pattern: str, second: str) -> tuple[ByteBpe, Pieces]:
    """Both tokenizers, once for each worker process."""
    key = first, pattern, second
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(first, pattern), Pieces(second)
    return _LOADED[key]


def _lists(ids: list) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate(ids) if ids and isinstance(ids[0], np.ndarray) else np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _spelled(tokens: pa.ListArray, by: Tokenizer) -> tuple[np.ndarray, memoryview]:
    """Where each document ends in the joined bytes of its tokens, and these bytes."""
    flat = pc.list_flatten(tokens)
    ends = np.concatenate(([0], np.cumsum(pc.take(by.lengths, flat).to_numpy(zero_copy_only=False))))
    return ends[tokens.offsets.to_numpy()], memoryview(pc.take(by.bytes, flat).buffers()[2] or b"").cast("B")


def _whole(texts: list[bytes], sides: list[tuple[pa.ListArray, Tokenizer]]) -> np.ndarray:
    """Which texts come back byte by byte from the tokens of each side."""
    fine = np.ones(len(texts), dtype=bool)
    bounds, joined = np.concatenate(([0], np.cumsum([len(t) for t in texts]))), b"".join(texts)
    for tokens, by in sides:
        ends, data = _spelled(tokens, by)
        if np.array_equal(ends, bounds) and data[:len(joined)] == joined:
            continue
        fine &= [data[a:b] == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)]
    return fine


def _side(tokens: pa.ListArray, by: Tokenizer, name: str) -> pa.Table:
    """End offset, document and id of each token."""
    flat = pc.list_flatten(tokens)
    return pa.table({"end": pc.cumulative_sum(pc.take(by.lengths, flat).cast(pa.int64())), f"doc_{name}": pc.list_parent_indices(tokens).cast(pa.int64()), name: flat})


def _joined(values: pa.Array, upto: np.ndarray, sign: str) -> pa.Array:
    """Strings joined in runs that end before the given places."""
    offsets = np.concatenate(([0], upto)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), sign)


def align(a: pa.ListArray, b: pa.ListArray, first: Tokenizer, second: Tokenizer) -> tuple[list[np.ndarray], pa.Array, pa.Table]:
    """Groups and links of each document, the digest of its groups, and its distinct id pairs in order (``doc, pair, n``)."""
    n, width = len(a), len(second.entries)
    left, right = _side(a, first, "a"), _side(b, second, "b")
    ends = left.join(right, "end", join_type="full outer", use_threads=False).combine_chunks()
    ends = ends.take(np.argsort(ends["end"].to_numpy(), kind="stable"))
    of_a, of_b = (pc.is_valid(ends[name]).to_numpy() for name in ("a", "b"))
    both = of_a & of_b
    doc = pc.coalesce(ends["doc_a"], ends["doc_b"]).to_numpy()
    one, two = (pc.fill_null_backward(ends[name]).to_numpy().astype(np.int64) for name in ("a", "b"))
    key, times = np.unique(doc << 40 | one * width + two, return_counts=True)
    pairs = pa.table({"doc": key >> 40, "pair": key & (1 << 40) - 1, "n": times})
    groups = pc.binary_join_element_wise(*[
        _joined(side.combine_chunks().cast(pa.string()), np.flatnonzero(both[own]) + 1, ",")
        for side, own in ((left["a"], of_a), (right["b"], of_b))], "|")
    n_groups = np.bincount(doc[both], minlength=n)
    n_links = np.bincount(doc, minlength=n)
    lines = _joined(groups, np.cumsum(n_groups), ";")
    digests = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in lines.cast(pa.binary())], pa.string())
    return [n_groups, n_links], digests, pairs


def _packed(pairs: pa.Table, n: int, width: int, kinds: tuple[np.dtype, np.dtype]) -> list[list[bytes]]:
    """Per document: first ids as steps, second ids, and numbers, as bytes."""
    bounds = np.searchsorted(pairs["doc"].to_numpy(), np.arange(n + 1))
    one, two = np.divmod(pairs["pair"].to_numpy(), width)
    steps = np.diff(one, prepend=0)
    starts = bounds[:-1][np.diff(bounds) > 0]
    steps[starts] = one[starts]
    columns = [steps.astype(kinds[0]), two.astype(kinds[1]), pairs["n"].to_numpy().astype(np.uint32)]
    cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return [[c[s:e].tobytes() for s, e in cut] for c in columns]


def _unpacked(row: tuple[pa.Scalar, ...], width: int, kinds: tuple[np.dtype, np.dtype]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and numbers of one document."""
    one, two, times = (np.frombuffer(x.as_buffer(), dtype=k) for x, k in zip(row, (*kinds, np.dtype(np.uint32))))
    return np.cumsum(one, dtype=np.int64) * width + two, times


def aligned(docs: DataFrame, first: str, pattern: str, second: str) -> DataFrame:
    """Each row's counts and groups, and its distinct pairs, packed (``ones``, ``twos``, ``times``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers(first, pattern, second)
        for texts in slices(batches, limit=4 * SLICE_BYTES):
            yield _rows(texts, one, two)

    return documents(docs).mapInArrow(run, f"{_COLUMNS}, ones binary, twos binary, times binary")


def _rows(texts: Texts, one: Tokenizer, two: Tokenizer) -> pa.RecordBatch:
    at = [i for i in range(len(texts)) if texts.bounds[i] < texts.bounds[i + 1]]
    spaced = [b" " + texts.raw(i) for i in at]
    a = _lists(one.encode([t.decode() for t in spaced]))
    b = _lists(two.encode([t[1:].decode() for t in spaced]))
    fine = _whole(spaced, [(a, one), (b, two)])
    if not fine.all():
        a, b, at = a.filter(pa.array(fine)), b.filter(pa.array(fine)), [i for i, f in zip(at, fine) if f]
        a, b = (pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy()))).astype(np.int32)), pc.list_flatten(x))
                for x in (a, b))
    counts = np.zeros((4, len(texts)), dtype=np.int64)
    digests, packed = [""] * len(texts), [[b""] * len(texts) for _ in range(3)]
    if at:
        (groups, links), found, pairs = align(a, b, one, two)
        counts[:, at] = a.value_lengths().to_numpy(), b.value_lengths().to_numpy(), groups, links
        cells = _packed(pairs, len(at), len(two.entries), (one.kind, two.kind))
        for k, i in enumerate(at):
            digests[i] = found[k].as_py()
            for column, values in zip(packed, cells):
                column[i] = values[k]
    return pa.RecordBatch.from_arrays(
        [texts.rows.column("doc_id"), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), *[pa.array(c, pa.binary()) for c in packed]],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ones", "twos", "times"])


def pair_counts(rows: DataFrame, width: int, kinds: tuple[np.dtype, np.dtype], held: int = HELD) -> DataFrame:
    """``pair, n``: how many rows hold each pair."""

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        found = pa.table({"pair": np.concatenate(keys)}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        return found.select(["pair", "count_all"]).rename_columns(["pair", "n"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                found, _ = _unpacked(row, width, kinds)
                if len(found):
                    keys.append(found)
                    n += len(found)
            if n >= held:
                yield counted(keys)
                keys, n = [], 0
        if keys:
            yield counted(keys)

    parts = rows.select("ones", "twos", "times").mapInArrow(run, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def _by_lookup(rows: DataFrame, counts: DataFrame, width: int, kinds: tuple[np.dtype, np.dtype]) -> DataFrame:
    """The links of each row whose pair is a best one, and the counts of all its links, from a broadcast table."""
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy(), kind="stable")
    known = rows.sparkSession.sparkContext.broadcast((
        table["pair"].to_numpy()[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            for i, row in enumerate(zip(*(batch.column(c) for c in ("ones", "twos", "times")))):
                keys, times = _unpacked(row, width, kinds)
                at = np.searchsorted(pairs, keys)
                sums[:, i] = times[best[at]].sum(dtype=np.int64), (times * n[at]).sum(dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    return rows.select(*names, "ones", "twos", "times").mapInArrow(run, f"{_COLUMNS}, n_best bigint, count_sum bigint")


def _by_join(rows: DataFrame, counts: DataFrame, width: int, kinds: tuple[np.dtype, np.dtype]) -> DataFrame:
    """The same by a join of all pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                keys, times = _unpacked(row[1:], width, kinds)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), row[0].as_py())), pa.array(keys), pa.array(times.astype(np.int64))], names=["row", "pair", "times"])

    held = rows.select("row", "ones", "twos", "times").mapInArrow(run, "row bigint, pair bigint, times bigint")
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("ones", "twos", "times").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def cross_tokenizer(docs: DataFrame, first: str, pattern: str, second: str, broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row."""
    spark = docs.sparkSession
    one, two = tokenizers(first, pattern, second)
    width, kinds = len(two.entries), (one.kind, two.kind)
    path = scratch_path(spark, "aligned")
    aligned(docs, first, pattern, second).withColumn("row", F.monotonically_increasing_id()).write.option(
        "compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    rows = spark.read.parquet(path)
    counts = checkpointed(pair_counts(rows, width, kinds))
    # At most one row for each entry of the first vocabulary.
    most = counts.groupBy(F.floor(F.col("pair") / width).alias("one")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("one", F.floor(F.col("pair") / width)).join(F.broadcast(most), "one")
    ranked = ranked.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if counts.count() <= broadcast:
        return _by_lookup(rows, ranked, width, kinds)
    return _by_join(rows, checkpointed(ranked), width, kinds)
