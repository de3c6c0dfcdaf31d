"""The vector index against exact search, and BM25 pruning against plain scores on larger data."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from datalumen.operators import nearest, ranking, search


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    data = centres[rng.integers(0, 40, 6000)] + rng.normal(scale=0.9, size=(6000, 24))
    data[4000:] = data[17]  # a third of all rows are copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data.astype(np.float32))]
    return spark.createDataFrame(rows, "id bigint, v array<float>").repartition(6)


def recall(found, exact):
    """Share of the exact scores that are met; among equal scores any row will do."""
    want, got = defaultdict(list), defaultdict(Counter)
    for r in exact:
        want[r.query_id].append(r.score)
    for r in found:
        got[r.query_id][round(r.score, 5)] += 1
    hits = 0
    for q, scores in want.items():
        hits += sum((Counter(round(s, 5) for s in scores) & got[q]).values())
    return hits / sum(map(len, want.values()))


def test_index_recall_and_slices_of_a_hot_bucket(cloud, monkeypatch):
    monkeypatch.setattr(nearest, "SLICE_ROWS", 300)
    asked = cloud.where("id % 100 = 0")
    exact = search.vector_topk(asked, "id", "v", cloud, "id", "v", 10).collect()
    index = search.vector_index(cloud, "id", "v")
    assert index.rows.count() == 6000 and sum(r["n"] for r in index.sizes.collect()) == 6000
    assert len(index.centres) > 30
    found = search.vector_index_topk(asked, "id", "v", index, 10)
    assert recall(found.collect(), exact) >= 0.95
    everywhere = search.vector_index_topk(asked, "id", "v", index, 10, probes=len(index.centres))
    assert {tuple(r) for r in everywhere.collect()} == {tuple(r) for r in exact}


def test_exact_search_in_blocks_and_slices(cloud, monkeypatch):
    asked = cloud.where("id % 300 = 0")
    whole = {tuple(r) for r in search.vector_topk(asked, "id", "v", cloud, "id", "v", 7).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(nearest, "SLICE_ROWS", 500)
    monkeypatch.setattr(nearest, "CELLS", 1000)
    assert {tuple(r) for r in search.vector_topk(asked, "id", "v", cloud, "id", "v", 7).collect()} == whole
    assert len(whole) == 20 * 7


def test_an_index_of_nothing(spark, cloud):
    index = search.vector_index(cloud.limit(0), "id", "v")
    assert search.vector_index_topk(cloud.limit(0), "id", "v", index).count() == 0


@pytest.mark.parametrize("first, piece, cells", [(64, 2048, 4_000_000), (3, 7, 40), (1, 1000, 500)])
def test_pruned_scores_equal_plain_ones(monkeypatch, first, piece, cells):
    import pyarrow as pa

    monkeypatch.setattr(ranking, "FIRST", first)
    monkeypatch.setattr(ranking, "PIECE", piece)
    monkeypatch.setattr(ranking, "CELLS", cells)
    rng = np.random.default_rng(first)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(0, 25), p=share / share.sum())) for _ in range(300)]
    texts[5] = None
    queries = [sorted(set(rng.choice(words, rng.integers(1, 9)))) for _ in range(20)]
    weight = {w: float(x) for w, x in zip(words, np.concatenate(([-0.2, 0.1], np.log1p(np.arange(1, 59)))))}
    run = ranking.Ranked(9.0, 4)
    run.ask(pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(queries), pa.array([[weight[w] for w in q] for q in queries])],
                                       names=["id", "terms", "weights"]))
    for low in range(0, 300, 100):
        run.read(pa.RecordBatch.from_arrays([pa.array(range(low, low + 100), pa.int64()), pa.array(texts[low:low + 100], pa.string())], names=["id", "text"]))
    got = sorted(zip(*(x.tolist() for x in run.best())))
    want = []
    for q, terms in enumerate(queries):
        scores = []
        for i, text in enumerate(texts):
            split = (text or "").split()
            norm = 1.5 * (0.25 + 0.75 * len(split) / 9.0)
            s = round(sum(weight[t] * split.count(t) * 2.5 / (split.count(t) + norm) for t in terms if t in split), 6)
            if s > 0:
                scores.append((-s, i))
        want += [(q, i, -s) for s, i in sorted(scores)[:4]]
    assert [(q, i) for q, i, _ in got] == sorted((q, i) for q, i, _ in want)
