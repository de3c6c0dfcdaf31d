"""Tokens per section of a document, from one encoding of the whole document.

The whole text is encoded once; the token byte lengths give every token's span, and the spans are interval-joined with
the sections by binary search over the sorted token starts. A token that crosses a boundary belongs to the section that
holds its first character, so the counts of sections that cover the text add up to the tokens of the text.

Null and empty texts have one empty section and no tokens. Repeated rows each get their own rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import Texts, slices, small_batches

_ENCODINGS: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str) -> tuple:
    """The encoding of a rank file and the byte length of each of its tokens, one for each worker process."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODINGS[path, pattern]


def _line_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as byte spans, each with its line feed."""
    ends = np.flatnonzero(data == 0x0A) + 1
    return np.concatenate(([0], ends)), np.concatenate((ends, [len(data)]))


def _given_bounds(data: np.ndarray, sections: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Spans in characters as spans in bytes."""
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    clipped = [np.clip([s[c] for s in sections], 0, len(at) - 1).astype(np.int64) for c in ("start", "stop")]
    return at[clipped[0]], at[clipped[1]]


def attribute(starts: np.ndarray, stops: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that start in each section, and how many of them end outside it."""
    first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
    n = np.maximum(last - first, 0)
    crossing = np.zeros(len(low), dtype=np.int64)
    some = n > 0
    crossing[some] = stops[last[some] - 1] > high[some]
    return n, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: str | None = None) -> DataFrame:
    """``doc_id, section, n_tokens, n_crossing``: the tokens of every section.

    ``sections`` names a column of ``array<struct<start, stop>>`` in characters (they may overlap or leave gaps); without it, lines are the sections.
    """
    small_batches(docs)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       *([F.col(sections).alias("sections")] if sections else []))

    def of(texts: Texts, i: int, given: list | None) -> tuple[np.ndarray, np.ndarray]:
        encode, sizes = encoding(path, pattern)
        data = texts.data[texts.bounds[i]:texts.bounds[i + 1]]
        stops = np.cumsum(sizes[np.array(encode.encode_ordinary(data.tobytes().decode()), dtype=np.int64)])
        starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        return attribute(starts, stops, *(_line_bounds(data) if given is None else _given_bounds(data, given)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            given = [x or [] for x in texts.rows.column("sections").to_pylist()] if sections else [None] * len(texts)
            counts = [of(texts, i, given[i]) for i in range(len(texts))]
            sizes = [len(n) for n, _ in counts]
            row = np.repeat(np.arange(len(texts)), sizes)
            section = np.concatenate([np.arange(n) for n in sizes])
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(pa.array(row)), pa.array(section.astype(np.int32)),
                *[pa.array(np.concatenate([c[k] for c in counts]).astype(np.int64)) for k in (0, 1)]],
                names=["doc_id", "section", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, "doc_id bigint, section int, n_tokens bigint, n_crossing bigint")
