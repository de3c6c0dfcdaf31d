"""Retrieval packing: every id in one place, full windows, neighbours first, and the index against plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from datalumen.llm import retrieval_packing as rp
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, signature string, row string, ids string"


def rows():
    rng = random.Random(4)
    topics = [["river", "boat", "water", "bank", "fish"], ["engine", "wheel", "motor", "road", "fuel"], ["éclair", "sugar", "ofen", "mehl", "butter"]]
    texts = [None, "", " \n", "one", "don't <|endoftext|> stop", "日本語 text", "a\x00b"]
    for i in range(200):
        words = topics[i % 3] + ["the", "of", "and"]
        texts.append(" ".join(rng.choices(words, k=rng.choice([3, 40, 300, 900]))))
    texts += [texts[30]] * 60 + ["long " * 9000, " ".join(topics[0] * 410)]
    return [(i if i % 11 else None, t, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(7)


@pytest.mark.parametrize("size, shard, task", [(2048, 1 << 19, 1 << 22), (2048, 20_000, 30_000), (64, 500, 4000)])
def test_each_id_has_one_place(table, size, shard, task):
    found = rp.pack(table, PATH, size, shard=shard, task=task, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, *_ in rows():
        want[doc, tuple(whole.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length > 0
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, tuple(r.ids)))
    lengths = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        lengths.append(sum(n for _, n in parts))
    assert all(n == size or n < size and not n & (n - 1) for n in lengths)
    tasks = len({s >> 40 for s in sequences if s >= 0})
    assert sum(n < size for n in lengths) <= tasks * size.bit_length()
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(lengths) == total
    # Pieces of a document with a unique id and length follow each other without gaps and give its ids back.
    got = Counter()
    for (doc, n), parts in pieces.items():
        if doc is not None and len({p[0] for p in parts}) == len(parts):
            parts.sort()
            ids = tuple(x for p in parts for x in p[2])
            assert len(ids) == n
            got[doc, ids] += 1
    assert got == Counter({k: v for k, v in want.items() if k[0] is not None})
    assert sum(p[1] for (doc, _), parts in pieces.items() if doc is None for p in parts) == sum(
        len(ids) * n for (doc, ids), n in want.items() if doc is None)


def parts_of(texts):
    vocabulary = sorted({w for t in texts for w in t.split()})
    return [rp.Part(i, np.array([vocabulary.index(w) for w in t.split()], dtype=np.uint16), 0, len(t.split())) for i, t in enumerate(texts)], vocabulary


def test_index_ranks_as_plain_bm25():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 30))) for _ in range(80)]
    parts, vocabulary = parts_of(texts)
    df = np.array([sum(w in t.split() for t in texts) for w in vocabulary])
    idf, average = np.log1p((80 - df + 0.5) / (df + 0.5)), sum(len(p.ids) for p in parts) / 80
    index = rp.Index(parts, idf, average)
    alive = np.arange(80) % 3 > 0
    for kept in (False, True):
        if kept:
            index.keep(alive)
        for query in texts[:20]:
            scores = []
            for i, t in enumerate(texts):
                words = t.split()
                norm = 1.5 * (0.25 + 0.75 * len(words) / average)
                scores.append(sum(math.log1p((80 - df[vocabulary.index(w)] + 0.5) / (df[vocabulary.index(w)] + 0.5)) * words.count(w) * 2.5
                                  / (words.count(w) + norm) for w in set(query.split()) if w in words) if alive[i] or not kept else 0)
            got = index.ranked(np.array([vocabulary.index(w) for w in query.split()]))
            assert np.allclose(np.array(scores)[got], sorted(scores, reverse=True))


def test_windows_hold_the_nearest_unused(table):
    texts = ["a a a b"] * 2 + ["x y z q"] * 4 + ["a b c d"] * 2
    parts, vocabulary = parts_of(texts)
    idf = np.ones(len(vocabulary))
    made = [[p.doc for p in w] for w in rp.windows(parts, idf, 4.0, 8)]
    assert made == [[0, 1], [2, 3], [4, 5], [6, 7]]
    # In the whole job, most windows hold documents of one topic.
    found = rp.pack(table.where("doc_id between 7 and 206"), PATH, 512, with_ids=True).collect()
    topic = {i: (i - 7) % 3 for i in range(7, 207)}
    sequences = defaultdict(Counter)
    for r in found:
        sequences[r.sequence_id][topic[r.doc_id]] += r.length
    assert sum(max(c.values()) for c in sequences.values()) > 0.9 * sum(sum(c.values()) for c in sequences.values())


def test_nothing_to_pack(spark):
    assert rp.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    only = rp.pack(spark.createDataFrame([(5, None)], "doc_id bigint, text string"), PATH).collect()
    assert [tuple(r)[:3] + tuple(r)[4:5] + tuple(r)[6:] for r in only] == [(5, 0, 1, 1, 0)]
