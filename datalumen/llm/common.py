"""What the text operators share: Arrow batches in bounded slices, words and word-sequence hashes as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 16
#: Rows of an Arrow batch, where the session has no setting of its own; the default of 10,000 is too much for texts.
BATCH_ROWS, _BATCH_SETTING = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"

_SPACE = np.ones(256, dtype=np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: Per byte: itself, or 0 for the separators of ``[^\x20\x09-\x0D]+``. A NUL byte is a letter, coded as 0xFF (never in UTF-8).
PLAIN = np.where(_SPACE, np.arange(256), 0).astype(np.uint8)
PLAIN[0] = 0xFF
#: Per byte: A-Z lowered, or 0 for the separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering.
LOWERED = np.zeros(256, dtype=np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LOWERED[_b] = _b
for _b in range(0x41, 0x5B):
    LOWERED[_b] = _b + 32

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = (self._powers(b, n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        have = 1
        while have < n:
            more = min(have, n - have)
            out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        return out


_POWERS = tuple(Powers(b) for b in _BASES)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Sequences:
    """Hashes of any run of values of one array, each in constant time."""

    def __init__(self, values: np.ndarray, which: int):
        self.powers = _POWERS[which]
        up, _ = self.powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, down = self.powers.upto(len(self.sums))
        h = (self.sums[stop] - self.sums[start]) * down[start]
        return mixed(h + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Texts:
    """Some rows' texts as one byte array: text ``i`` is ``data[bounds[i]:bounds[i + 1]]``, empty for null."""

    data: np.ndarray
    bounds: np.ndarray
    rows: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)


class Words:
    """The words of some texts: byte spans, hashes, and ``first[i]:first[i + 1]`` the words of text ``i``."""

    def __init__(self, texts: Texts, table: np.ndarray):
        code = table[texts.data]
        inside = code != 0
        n = len(code)
        edge = np.zeros(n + 1, dtype=bool)
        edge[texts.bounds] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:n]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, texts.bounds)
        self.code = code

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Sequences(_BYTE[self.code], 0).of(self.start, self.stop)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of the batches, a bounded number of text bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
        whole = array.buffers()[2]
        data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(array):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            yield Texts(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at], batch.slice(at, to - at))
            at = to


def small_batches(df: DataFrame) -> None:
    """Let batches of rows with texts stay small."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "10000":
        conf.set(_BATCH_SETTING, BATCH_ROWS)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (and further text columns) of a table, so that other columns cannot clash."""
    small_batches(df)
    return df.select(df["doc_id"].cast("bigint").alias("doc_id"), *[df[c].cast("string").alias(c) for c in ("text", *more)])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key(df: DataFrame) -> DataFrame:
    """Add ``row_key``, equal only for rows with the same id and text."""
    return df.withColumn("row_key", F.xxhash64("doc_id", "text"))


def marked(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the half-open spans."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0
