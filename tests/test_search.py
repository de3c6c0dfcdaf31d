import math
from collections import Counter

import numpy as np
import pytest

from datalumen.operators import pages, search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(90)]
    docs += [(90 + i, docs[5][1]) for i in range(40)]  # one text holds about a third of the rows
    docs.append((200, "  \t "))
    asked = [(i, " ".join(rng.choice(words, 4))) for i in range(7)] + [(9, "unheard of"), (10, "")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), docs,
            spark.createDataFrame(asked, "q bigint, text string"), asked)


def brute_bm25(docs, asked, k):
    split = {i: t.split() for i, t in docs}
    n, avgdl = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(t for ws in split.values() for t in set(ws))
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    out = []
    for q, text in asked:
        scores = []
        for i, ws in split.items():
            tf = Counter(ws)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for t in text.split() if t in tf)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, words", [(256, 20_000), (2, 20_000), (256, 5)])
def test_bm25_equals_brute_force(corpus, monkeypatch, block, words):
    docs, doc_rows, asked, asked_rows = corpus
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_WORDS", words)
    got = search.bm25_topk(asked, "q", "text", docs, "doc_id", "text", 4).select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, got)) == brute_bm25(doc_rows, asked_rows, 4)


def test_vectors_and_diversity_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 8))
    data[40:] = data[7] + rng.normal(scale=1e-3, size=(20, 8))
    store = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, v array<double>")
    asked = spark.createDataFrame([(1, [float(x) for x in data[7]]), (2, [float(x) for x in data[3]])], "q bigint, v array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    nearest, diverse = [], []
    for q, src in ((1, 7), (2, 3)):
        sim = np.round(unit @ unit[src], 6)
        pool = sorted(range(60), key=lambda i: (-sim[i], i))[:10]
        nearest += [(q, i, r + 1) for r, i in enumerate(pool[:6])]
        picked = [pool[0]]
        while len(picked) < 5:
            rest = [i for i in pool if i not in picked]
            value = {i: round(0.5 * sim[i] - 0.5 * max(unit[i] @ unit[p] for p in picked), 9) for i in rest}
            picked.append(max(rest, key=lambda i: (value[i], -pool.index(i))))
        diverse += [(q, i, r + 1) for r, i in enumerate(picked)]
    got = search.vector_topk(asked, "q", "v", store, "id", "v", 6).select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(nearest)
    got = search.vector_mmr(asked, "q", "v", store, "id", "v").select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(diverse)


def test_rows_without_a_vector_are_left_out_and_other_sizes_refused(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0]), (5, [1.0, None])]
    store = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = search.vector_topk(store, "id", "v", store, "id", "v", 1).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (4, 4)]
    assert [tuple(r["v"]) for r in search.centroids(store.where("id < 5"), "id", "v").orderBy("id").collect()] == [(1.0, 0.0), (0.0, 1.0)]
    assert search.vector_topk(store.limit(0), "id", "v", store, "id", "v").count() == 0
    assert search.centroids(store.limit(0), "id", "v").count() == 0
    ragged = store.union(spark.createDataFrame([(6, [1.0, 2.0, 3.0])], store.schema))
    with pytest.raises(Exception, match="expected vectors of 2 values"):
        search.vector_topk(store, "id", "v", ragged, "id", "v").collect()
    with pytest.raises(ValueError, match="different sizes"):
        search.vector_topk(ragged, "id", "v", store, "id", "v").collect()


def test_plan_does_not_grow_with_the_blocks_of_queries(corpus, spark, monkeypatch):
    docs, _, _, _ = corpus
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)

    def plan(queries):
        asked = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(queries)] + [(99, None)], "q bigint, text string")
        hits = search.bm25_topk(asked, "q", "text", docs, "doc_id", "text", 2)
        assert hits.select("query_id").distinct().count() == queries
        return len(hits._jdf.queryExecution().analyzed().toString().splitlines())

    assert plan(2) == plan(5)


def test_chunks_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(65))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "id int, t string")
    rows = search.chunk_documents(df, "id", "t", 30, 10).orderBy("id", "chunk").collect()
    assert [(r["id"], r["chunk"], r["text"]) for r in rows] == [
        (1, 0, text[:30]), (1, 1, text[20:50]), (1, 2, text[40:70]), (1, 3, text[60:]), (3, 0, "short")]


def test_result_links_with_snippets(spark):
    page = (
        '<a class="result-link" href="https://x.example/a">Shop &amp; <b>trade</b>\n report</a>\n'
        '<div class="result-snippet">A <i>rate</i> of 3&nbsp;%</div>'
        '<a class="big result__a" href="javascript:go()">No</a>'
        "<a class='result__a' href=' https://x.example/b '>Second</a>"
        '<a href="/other">other</a>')
    plain = "<p><a href='/one'><img></a><a href='/two'>Two</a></p>"
    df = spark.createDataFrame([(1, page), (2, plain), (3, "no links")], "id int, html string")
    rows = pages.page_links(df, "id", "html").orderBy("id", "rank").collect()
    assert [tuple(r) for r in rows] == [
        (1, 1, "https://x.example/a", "Shop & trade report", "A rate of 3 %"),
        (1, 2, "https://x.example/b", "Second", ""), (2, 1, "/two", "Two", "")]


def test_keyword_lines_keep_order(spark):
    df = spark.createDataFrame([(1, "alpha one\n beta\nALPHA two\nthe end")], "id int, t string")
    rows = search.keyword_lines(df, "id", "t", "the alpha", 5).collect()
    assert [tuple(r) for r in rows] == [(1, 1, "alpha one"), (1, 2, "ALPHA two")]


def test_pieces_are_bounded_by_their_text(monkeypatch):
    import pyarrow as pa

    from datalumen.operators import ranking
    texts = ["a b"] * 200 + [None, "", "word " * 3000, "x y z" * 50] + ["c d" * 500] * 100
    rows = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    seen = []
    monkeypatch.setattr(ranking, "PIECE_BYTES", 10_000, raising=False)
    scorer = ranking.Ranked(3.0, 2)
    scorer.ask(pa.RecordBatch.from_pydict({"id": [1], "terms": [["a", "word"]], "weights": [[1.0, 1.0]]}))
    monkeypatch.setattr(scorer, "_piece", seen.append)
    scorer.read(rows)
    assert [x for piece in seen for x in piece["id"].to_pylist()] == list(range(len(texts)))
    assert len(seen[0]) == ranking.FIRST
    assert all(len(piece) == 1 or sum(len(t or "") for t in piece["text"].to_pylist()) <= 10_000 for piece in seen)
