"""Quality rules: plain counts per document, and lines that too many documents of one host repeat.

Lines are normalised (A-Z lowered, white space runs become one space) and hashed. Documents of a host are counted by a
hash of the whole text, so exact copies count once. A line held by more documents than ``max(least, share * documents
of the host)`` is frequent. Frequent lines are removed; a document that loses more than ``depleted`` of its words is rejected. A text
in thousands of edited copies counts as often as it is edited.

Null and empty texts have no words and fail the base rules. Rows without a host form a host of their own. Repeated
rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import PLAIN, SLICE_BYTES, Sequences, documents, key, marked, slices, unused
from datalumen.session import checkpointed

LEAST, SHARE, DEPLETED = 20, 0.005, 0.8
MIN_WORDS, MAX_REPEATED = 20, 0.3
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def normalised(line: bytes) -> int:
    """The hash of a normalised line."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(line.lower().split())))


def _lines(text: bytes) -> tuple[int, list[dict]]:
    """Repeated lines, and hash and words in all of each distinct normalised line."""
    seen, repeated, words = set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            repeated += line in seen
            seen.add(line)
            h = normalised(line)
            words[h] = words.get(h, 0) + n
    return repeated, [{"line": h, "words": n} for h, n in words.items()]


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Where values occur twice or more."""
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.flatnonzero(np.isin(hashes, twice)) if len(twice) else np.zeros(0, dtype=np.int64)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content, lines`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            words = texts.words(PLAIN)
            first, text_of = words.first, words.text_of()
            runs = Sequences(words.hashes(), 1)
            last = first[1:][text_of]
            at = np.flatnonzero(np.arange(len(words)) + 8 <= last)
            own = runs.of(at, at + 8) + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            hit = at[_repeats(own)]
            repeated = np.concatenate(([0], np.cumsum(marked(len(words), hit, hit + 8))))
            points = np.concatenate(([0], np.cumsum(((texts.data & 0xC0) != 0x80) & (words.code != 0))))
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[texts.data])))
            lines = [_lines(texts.raw(i)) for i in range(len(texts))]
            content = [_signed(xxhash.xxh64_intdigest(texts.raw(i))) for i in range(len(texts))]
            of = lambda sums, bounds: pa.array(np.diff(sums[bounds]))
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id"), texts.rows.column("row_key"), texts.rows.column("source"), pa.array(np.diff(first)),
                of(points, texts.bounds), of(symbols, texts.bounds), pa.array([n for n, _ in lines], pa.int64()), of(repeated, first),
                pa.array(content, pa.int64()), pa.array([x for _, x in lines], _LINES)],
                names=["doc_id", "row_key", "host", *_COUNTS, "content", "lines"])

    return key(documents(docs, "source")).mapInArrow(
        run, "doc_id bigint, row_key bigint, host string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
        + ", content bigint, lines array<struct<line:bigint,words:int>>")


def frequent_lines(measured: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``host, line`` of the lines above the limit of their host (``host`` as a hash)."""
    each = measured.select("host", "content", F.explode("lines.line").alias("line"))
    counts = each.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    sizes = measured.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    limits = checkpointed(sizes.select(F.col("host").alias("of"), F.greatest(F.lit(float(least)), F.col("docs") * share).alias("limit")))
    some = checkpointed(counts)
    return some.join(limits, some["host"] == limits["of"]).where("n > limit").select("host", "line")


def assess(docs: DataFrame, least: int = LEAST, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Every row's counts, ``removed`` (words in frequent lines), ``frequent`` (their hashes), ``base_failed`` and ``kept``."""
    measured = checkpointed(measures(docs).withColumn("host", F.xxhash64("host")))
    frequent = checkpointed(frequent_lines(measured, least, share))
    held = measured.select("row_key", "host", F.explode("lines").alias("l")).select("row_key", "host", "l.line", "l.words")
    found = held.distinct().join(frequent, ["host", "line"]).groupBy("row_key").agg(
        F.sum("words").alias("removed"), F.collect_list("line").alias("frequent"))
    rows = measured.drop("lines", "content", "host").join(checkpointed(found), "row_key", "left")
    rows = rows.withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.lit(round(MAX_REPEATED * 100)) * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("removed") <= F.col("n_words") * depleted))


def without_lines(text: bytes, frequent: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or normalised(x) not in frequent)


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, all columns, without their frequent lines (``n_chars`` follows the text)."""
    found = assess(docs, **limits).where("kept").select("row_key", "frequent").dropDuplicates(["row_key"])
    name, lines = unused(docs, "row_key"), unused(docs, "frequent")
    found = found.select(F.col("row_key").alias(name), F.col("frequent").alias(lines))
    keyed = docs.withColumn(name, F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string")))
    joined = keyed.join(checkpointed(found), name)
    place = joined.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, limit=4 * SLICE_BYTES):
            frequent = texts.rows.column(lines).to_pylist()
            changed = [without_lines(texts.raw(i), set(x)).decode() if x else None for i, x in enumerate(frequent)]
            text = texts.rows.column("text").to_pylist()
            out = [b if b is not None else a for a, b in zip(text, changed)]
            yield texts.rows.set_column(place, "text", pa.array(out, texts.rows.schema.field("text").type))

    out = joined.mapInArrow(cut, joined.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(lines) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[out[c] for c in docs.columns])
