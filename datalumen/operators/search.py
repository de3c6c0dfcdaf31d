"""Text chunks, ranked and plain text search, vector search, and conversation windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed
from datalumen.functions.columns import any_of, col, strip
from datalumen.operators.facing import HIT_SCHEMA
from datalumen.operators.nearest import SAMPLE, VectorIndex, build_index, exact
from datalumen.operators.ranking import bm25
from datalumen.session import checkpointed

# Chunk sizes.
CHUNK = 3000
OVERLAP = 200

#: Queries, and words of all their texts, that a task holds at once.
QUERY_BLOCK = 16_384
QUERY_WORDS = 2_000_000


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping pieces of each text with their number; row by row, without a shuffle."""
    step = size - overlap
    pieces = F.ceil(F.length(col(text)) / F.lit(float(step))).cast("int")
    rows = docs.filter(F.length(col(text)) > 0).select(col(key), col(text).alias("_t"), F.explode(
        F.sequence(F.lit(0), pieces - 1)).alias("chunk"))
    return rows.select(col(key), "chunk", F.substring("_t", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def tokens(c: Column) -> Column:
    """Tokens between white space; ends are stripped first, so that no empty token arises."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def bm25_topk(
    queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, doc_text: str, k: int = 4,
) -> DataFrame:
    """The k best documents per query by BM25 over white-space tokens; a document must score above 0.

    Words are counted in one pass and documents scored in one more, for any number of queries; a null text has no words. Rows with
    one query id are one query, and queries without an id are left out.
    """
    corpus = docs.select(col(doc_id).cast("bigint").alias("id"), col(doc_text).cast("string").alias("text"))
    asked = queries.select(col(query_id).cast("bigint").alias("id"), tokens(col(query_text)).alias("terms"))
    return bm25(asked, corpus, k, QUERY_BLOCK, QUERY_WORDS)


def _vectors(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """``name, v`` of the rows that have a vector; null and empty vectors and those with a null inside have none."""
    v = col(vector).cast("array<double>")
    return rows.select(col(key).cast("bigint").alias(name), v.alias("v")).filter(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


def _of_size(size: int) -> Column:
    """The vector, or an error where it has another size."""
    other = F.raise_error(F.concat(F.lit(f"expected vectors of {size} values, found one of "), F.size("v")))
    return F.when(F.size("v") == size, F.col("v")).otherwise(other.cast("array<double>"))


def centroids(vectors: DataFrame, group: str, vector: str, size: int | None = None) -> DataFrame:
    """The mean vector per group; one partial aggregation with one mean per dimension.

    The size is read from the data unless it is given. Rows without a vector do not count; another size is an error.
    """
    rows = vectors.select(col(group).alias("_group"), col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    if size is None:
        size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    same = rows.select("_group", _of_size(size).alias("v"))
    means = same.groupBy("_group").agg(F.count("*").alias("_n"), *[F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(size)])
    return means.select(F.col("_group").alias(group), F.array(*[f"_{i}" for i in range(size)]).cast("array<double>").alias(vector))


def _asked(queries: DataFrame, query_id: str, query_vector: str) -> tuple[DataFrame, int, int]:
    """The queries as ``id, v``, the size of their vectors (0 without any), and how many there are."""
    asked = _vectors(queries, query_id, query_vector, "id").where("id IS NOT NULL")
    size = asked.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.count("*").alias("n")).first()
    if size["low"] != size["high"]:
        raise ValueError(f"the query vectors have different sizes: {size['low']} to {size['high']}")
    return asked, size["low"] or 0, size["n"]


def vector_topk(
    queries: DataFrame, query_id: str, query_vector: str, vectors: DataFrame, vector_id: str, vector: str, k: int = 5,
) -> DataFrame:
    """The k nearest vectors per query by cosine, exactly, in one pass of the vectors.

    Rows without a vector, and those with a null inside it, are left out on both sides; vectors of different sizes are an error.
    """
    asked, size, n = _asked(queries, query_id, query_vector)
    rows = _vectors(vectors, vector_id, vector, "id")
    if size:
        rows = rows.select("id", _of_size(size).alias("v"))
    return exact(asked, n, rows, vectors.count(), k, QUERY_BLOCK)


def vector_index(vectors: DataFrame, vector_id: str, vector: str, buckets: int | None = None, sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
    """An index of all vectors for ``vector_index_topk``; it can be searched any number of times."""
    rows = _vectors(vectors, vector_id, vector, "id")
    size = rows.agg(F.max(F.size("v"))).first()[0]
    return build_index(rows.select("id", _of_size(size).alias("v")) if size else rows, buckets, sample, path)


def vector_index_topk(queries: DataFrame, query_id: str, query_vector: str, index: VectorIndex, k: int = 5, probes: int | None = None) -> DataFrame:
    """The k nearest vectors per query among those in its ``probes`` nearest buckets (a quarter of all, at least 16, unless given)."""
    asked, _, _ = _asked(queries, query_id, query_vector)
    return index.search(asked, k, probes or max(16, len(index.centres) // 4))


def vector_mmr(
    queries: DataFrame, query_id: str, query_vector: str, vectors: DataFrame, vector_id: str, vector: str,
    k: int = 5, fetch: int = 10, balance: float = 0.5,
) -> DataFrame:
    """Of the ``fetch`` nearest vectors the k that are near the query and unlike each other."""
    # Written down, as it is counted and joined: ``fetch`` rows per query.
    near = checkpointed(vector_topk(queries, query_id, query_vector, vectors, vector_id, vector, fetch))
    store = _vectors(vectors, vector_id, vector, "doc_id")
    pool = store.join(F.broadcast(near), "doc_id") if near.count() <= 100_000 else store.join(near, "doc_id")

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        data = np.array(pool["v"].tolist())
        data = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
        sim, near = data @ data.T, pool["score"].to_numpy()
        picked = [0]
        while len(picked) < min(k, len(pool)):
            value = balance * near - (1 - balance) * sim[:, picked].max(axis=1)
            value[picked] = -np.inf
            picked.append(int(np.argmax(np.round(value, 9))))
        out = pool.loc[picked, ["query_id", "doc_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return pool.groupBy("query_id").applyInPandas(choose, HIT_SCHEMA + ", rank bigint")


def keyword_search(docs: DataFrame, key: str, text: str, query: str, k: int = 5) -> DataFrame:
    """The first k documents, by key, that hold any word of the query as a substring."""
    lower = F.lower(col(text))
    hit = any_of([lower.contains(w) for w in query.lower().split()])
    return docs.filter(hit).select(col(key), F.length(col(text)).alias("length")).orderBy(col(key)).limit(k)


def keyword_lines(docs: DataFrame, key: str, text: str, query: str, lines: int = 10) -> DataFrame:
    """The first lines of each text that hold a word of more than three letters from the query."""
    words = [w for w in query.lower().split() if len(w) > 3]
    found = F.filter(F.split(col(text), "\n"), lambda line: any_of([F.lower(line).contains(w) for w in words]))
    picked = F.posexplode(F.slice(found, 1, lines)).alias("_pos", "_line")
    return docs.select(col(key), picked).select(
        col(key), (F.col("_pos") + 1).cast("bigint").alias("line_rank"), strip(F.col("_line")).alias("line"))


def last_turns(turns: DataFrame, conversation: str, turn: str, exchanges: int = 8) -> DataFrame:
    """The turns of the last exchanges (a question and its answer) of each conversation."""
    number = F.floor(col(turn) / 2)
    last = turns.groupBy(col(conversation)).agg(F.max(number).alias("_last"))
    return turns.join(last, conversation).filter(number > F.col("_last") - exchanges).drop("_last")


def flag_external(rows: DataFrame, text: str) -> DataFrame:
    """Mark texts that ask for outside research."""
    return rows.withColumn("external", F.lower(col(text)).rlike("|".join(fixed.RESEARCH_TERMS)))
