"""BM25 over white-space tokens for any number of queries in one pass of the corpus, with max-score pruning.

Inside a task the rows of a slice are indexed piece by piece: postings of the block's words, each word with its greatest weight
(impact). A query's words are ordered by what they can add at most in this piece; the least of them, which together cannot lift a row
over the query's k-th best score, start no candidate. Only rows with one of the other words are scored, and the words left
out are looked up for those that may still get in. Frequent words, cheap in score and dear in postings, are so the ones that are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators.facing import Best, dealt, faced, spread, top
from datalumen.session import checkpointed

# Constants of the ranking; share of the mean weight that words with a negative one get.
K1, B, FLOOR = 1.5, 0.75, 0.25
#: Rows of the first piece of a slice and of the others, bytes of text of any piece, scores held at once, tokens of a slice.
FIRST, PIECE, PIECE_BYTES, CELLS, SLICE_TOKENS = 64, 2048, 8_000_000, 1_000_000, 8_000_000
_SLACK = 1e-5


class Ranked:
    """One block of queries over one slice of rows."""

    def __init__(self, average: float, k: int):
        self.average, self.k = average, k
        self.asked: list[pa.RecordBatch] = []
        self.ready = False

    def ask(self, queries: pa.RecordBatch) -> None:
        self.asked.append(queries.select(["id", "terms", "weights"]))

    def _index(self) -> None:
        table = pa.Table.from_batches(self.asked).combine_chunks()
        self.ids = table["id"].to_numpy()
        lists = table["terms"].combine_chunks()
        self.words = pc.unique(lists.flatten())
        self.entry_query = np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy())
        self.entry_word = pc.index_in(lists.flatten(), value_set=self.words).to_numpy().astype(np.int64)
        self.entry_weight = table["weights"].combine_chunks().flatten().to_numpy()
        self.held = Best(len(self.ids), self.k)
        self.ready, self.pieces = True, 0
        self.asked.clear()

    def read(self, rows: pa.RecordBatch) -> None:
        if not self.asked and not self.ready:
            return
        if not self.ready:
            self._index()
        first = FIRST if not self.pieces else 0
        for part in (rows.slice(0, first), rows.slice(first)):
            for piece in pieces(part, PIECE):
                self._piece(piece)
                self.pieces += 1

    def _piece(self, rows: pa.RecordBatch) -> None:
        n, words = rows.num_rows, len(self.words)
        ids = rows.column("id").to_numpy()
        lists = split_words(rows.column("text"))
        length = lists.value_lengths().to_numpy()
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(n), length)
        # Postings, by row and word.
        key, times = np.unique(row[word >= 0] * words + word[word >= 0], return_counts=True)
        if not len(key):
            return
        row, word = np.divmod(key, words)
        norm = K1 * (1 - B + B * length / self.average)
        weight = times * (K1 + 1) / (times + norm[row])
        impact = np.zeros(words)
        np.maximum.at(impact, word, weight)
        # What each word of each query can add at most, least first; the first of them may be left out.
        most = np.maximum(self.entry_weight, 0) * impact[self.entry_word]
        order = np.lexsort((most, self.entry_query))
        sums = np.cumsum(most[order])
        starts = np.searchsorted(self.entry_query[order], np.arange(len(self.ids)))
        sums -= np.concatenate(([0], sums))[starts][self.entry_query[order]]
        bar = np.maximum(self.held.bar, 0)
        out = np.zeros(len(order), dtype=bool)
        out[order] = sums <= bar[self.entry_query[order]] - _SLACK
        rest = np.bincount(self.entry_query[out], most[out], len(self.ids))
        lead = np.flatnonzero(~out)
        lead = lead[np.argsort(self.entry_word[lead], kind="stable")]
        first = np.searchsorted(self.entry_word[lead], np.arange(words + 1))
        left = np.flatnonzero(out)
        left_first = np.searchsorted(self.entry_query[left], np.arange(len(self.ids) + 1))
        step = max(1, CELLS // len(self.ids))
        for low in range(0, n, step):
            self._scored(low, min(step, n - low), ids, key, row, word, weight, lead, first, left, left_first, rest)

    def _scored(self, low: int, size: int, ids: np.ndarray, key: np.ndarray, row: np.ndarray, word: np.ndarray, weight: np.ndarray,
                lead: np.ndarray, first: np.ndarray, left: np.ndarray, left_first: np.ndarray, rest: np.ndarray) -> None:
        """Score some rows of the piece and keep the best."""
        queries, words = len(self.ids), len(self.words)
        a, b = np.searchsorted(row, [low, low + size])
        score = np.zeros(size * queries)
        while a < b:  # postings in parts, so that those of all queries with a word stay bounded
            n = first[word[a:b] + 1] - first[word[a:b]]
            stop = a + max(1, int(np.searchsorted(np.cumsum(n), CELLS, side="right")))
            n = n[:stop - a]
            of = np.repeat(np.arange(a, min(stop, b)), n)
            entry = lead[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[word[of]]]
            cell = (row[of] - low) * queries + self.entry_query[entry]
            score += np.bincount(cell, weight[of] * self.entry_weight[entry], len(score))
            a = stop
        bar = np.maximum(self.held.bar, 0)
        found = np.flatnonzero((score.reshape(size, queries) + rest > bar - _SLACK).ravel() & (score > 0))
        at, query = np.divmod(found, queries)
        score = score[found]
        n = left_first[query + 1] - left_first[query]
        for s in range(0, len(found), 1 << 18):
            of = np.repeat(np.arange(s, min(len(found), s + (1 << 18))), n[s:s + (1 << 18)])
            if not len(of):
                continue
            entry = left[np.arange(len(of)) - np.repeat(np.cumsum(n[s:s + (1 << 18)]) - n[s:s + (1 << 18)], n[s:s + (1 << 18)]) + left_first[query[of]]]
            want = (at[of] + low) * words + self.entry_word[entry]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            met = key[place] == want
            score += np.bincount(of[met], weight[place[met]] * self.entry_weight[entry[met]], len(score))
        good = (np.round(score, 6) > 0) & (score > self.held.bar[query] - _SLACK)
        self.held.add(query[good], ids[at[good] + low], score[good])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.ready:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return self.ids[self.held.query], self.held.row, self.held.score


def pieces(rows: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``most`` and of at most ``PIECE_BYTES`` of text; a row with more stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < rows.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + most, max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))))
        yield rows.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text between ASCII white space; none of a null or blank one."""
    bare = pc.fill_null(pc.ascii_trim_whitespace(texts), "")
    lists = pc.ascii_split_whitespace(bare)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    blank = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if not blank.any():
        return lists
    # A blank text is split into one empty word.
    n = np.where(blank, 0, lists.value_lengths().to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)),
                                    lists.flatten().filter(pa.array(np.repeat(~blank, lists.value_lengths().to_numpy()))))


def statistics(corpus: DataFrame) -> DataFrame:
    """``term, df`` of all words, and one row without a term: ``df`` rows and ``tokens`` tokens. One pass, counted piece by piece inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for rows in batches for piece in pieces(rows, rows.num_rows)):
            lists = split_words(batch.column("text"))
            coded = lists.flatten().dictionary_encode()
            words = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            held = np.unique(row * words + coded.indices.to_numpy(), return_counts=True)[0] % words
            n = np.bincount(held, minlength=words)[:len(coded.dictionary)]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([coded.dictionary, pa.array([None], pa.string())]), pa.array([*n.tolist(), len(lists)], pa.int64()),
                pa.array([0] * len(n) + [len(coded)], pa.int64())], names=["term", "df", "tokens"])

    parts = corpus.select("text").mapInArrow(run, "term string, df bigint, tokens bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def weighed(asked: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``id, terms, weights`` of the queries: how often a word is asked for times its inverse document frequency."""
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = counts.where("term IS NOT NULL").select("term", idf.alias("idf"))
    mean = words.agg(F.avg("idf")).first()[0] or 0.0
    each = asked.where("id IS NOT NULL").select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("qf"))
    weight = F.col("qf") * F.when(F.col("idf") >= 0, F.col("idf")).otherwise(FLOOR * mean)
    pairs = each.join(words, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("_w"))
    return pairs.select("id", F.col("_w.term").alias("terms"), F.col("_w.weight").alias("weights"))


def bm25(asked: DataFrame, corpus: DataFrame, k: int, block_queries: int, block_words: int) -> DataFrame:
    """The k best rows of ``corpus`` (``id, text``) for each query of ``asked`` (``id, terms``)."""
    spark = corpus.sparkSession
    counts = checkpointed(statistics(corpus))
    whole = counts.where("term IS NULL").first()
    n, tokens = (whole["df"], whole["tokens"]) if whole else (0, 0)
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("words")).first()
    blocks = max(1, math.ceil(size["n"] / block_queries), math.ceil((size["words"] or 0) / block_words))
    asked = weighed(asked, counts, n)
    slices = max(math.ceil(tokens / SLICE_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    average = tokens / n if tokens else 1.0
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_slice", spread(F.lit(slices)))
    held = corpus.withColumn("_slice", F.pmod(F.xxhash64("id", "text"), F.lit(slices)).cast("int")).withColumn("_block", spread(F.lit(blocks)))
    rows = dealt(asked, held, ["_slice", "_block"] if blocks > 1 else ["_slice"], slices if blocks == 1 else slices * blocks)
    return top(faced(rows.select("id", "text", "terms", "weights", "_slice", *(["_block"] if blocks > 1 else []), "_side"),
                     ["_slice", "_block"] if blocks > 1 else ["_slice"], lambda: Ranked(average, k)), k)

