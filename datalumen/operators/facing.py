"""A set of queries facing all rows of a table, block by slice, without either passing through the driver.

Rows are dealt to slices, queries to blocks. A row is sent once to its slice for each block, a query once to each slice, and a task
reads the queries of one block and then streams the rows of one slice past them. With one block, which holds thousands of
queries, the table is read and moved once however many there are. A task holds the queries of a block and the best rows so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT_SCHEMA = "query_id bigint, doc_id bigint, score double"


class Scorer(Protocol):
    """What a task does with one block of queries and one slice of rows."""

    def ask(self, queries: pa.RecordBatch) -> None: ...

    def read(self, rows: pa.RecordBatch) -> None: ...

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


class Best:
    """The k best rows of each query, by score to six places and then by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: Per query, the score that a further row must beat.
        self.bar = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row = np.concatenate([self.query, query]), np.concatenate([self.row, row])
        score = np.concatenate([self.score, np.round(score, 6)])
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.bar) + 1))
        place = np.arange(len(query)) - first[query]
        last = place == self.k - 1
        self.bar[query[last]] = score[last]
        keep = place < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]


def dealt(asked: DataFrame, held: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Both sides in the tasks of their keys, each key's queries (``_side`` 0) before its rows, rows by id."""
    both = asked.withColumn("_side", F.lit(0)).unionByName(held.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    place = F.pmod(F.xxhash64(*keys), F.lit(parts)) if len(keys) > 1 else F.pmod(F.col(keys[0]), F.lit(parts))
    return both.repartitionById(parts, place.cast("int")).sortWithinPartitions(*keys, "_side", "id")


def faced(rows: DataFrame, keys: list[str], begin: Callable[[], Scorer]) -> DataFrame:
    """The hits of one scorer for each key, from what ``dealt`` gives."""
    columns = [c for c in rows.columns if c not in (*keys, "_side")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, scorer = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "_side")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = marks[:-1, start].tolist()
                if key != current:
                    if scorer is not None:
                        yield hits(scorer)
                    current, scorer = key, begin()
                part = batch.slice(start, stop - start).select(columns)
                (scorer.read if marks[-1, start] else scorer.ask)(part)
        if scorer is not None:
            yield hits(scorer)

    return rows.mapInArrow(run, HIT_SCHEMA)


def hits(scorer: Scorer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in scorer.best()], names=["query_id", "doc_id", "score"])


def spread(count: Column) -> Column:
    """One row for each of ``count`` numbers from 0."""
    return F.explode(F.sequence(F.lit(0), count.cast("int") - 1))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)
