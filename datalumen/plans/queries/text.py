"""Text and vector search, conversation windows and page links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed
from datalumen.operators import pages, search
from datalumen.plans.registry import Tables, query

QUESTION = "the delivery of benchmark nicht question"


@query("chunk_documents", """
SELECT doc_id, CAST(chunk AS INT) AS chunk, substr(text, chunk * 2800 + 1, 3000) AS text
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2800.0) AS BIGINT))) AS chunk FROM documents)""")
def chunk_documents(t: Tables) -> DataFrame:
    return search.chunk_documents(t.documents, "doc_id", "text")


@query("bm25_topk", r"""
WITH k AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM k) * 1.0 / count(*) AS avgdl FROM documents),
l AS (SELECT doc_id, count(*) AS dl FROM k GROUP BY 1), f AS (SELECT doc_id, w, count(*) AS tf FROM k GROUP BY 1, 2),
i AS (SELECT w, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, n GROUP BY w, n),
v AS (SELECT w, CASE WHEN idf >= 0 THEN idf ELSE 0.25 * (SELECT avg(idf) FROM i) END AS idf FROM i),
q AS (SELECT item_id, w, count(*) AS qf FROM (
  SELECT item_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, f.doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN f USING (w) JOIN v USING (w) JOIN l USING (doc_id), n GROUP BY 1, 2)
SELECT item_id AS query_id, doc_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 4""")
def bm25_topk(t: Tables) -> DataFrame:
    hits = search.bm25_topk(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")
    return hits.withColumn("score", F.round("score", 4))


CENTROIDS = """e AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS m FROM e GROUP BY 1)"""


@query("vector_topk", f"""
WITH {CENTROIDS},
s AS (SELECT c.label AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.m), 6) AS score
  FROM embeddings v CROSS JOIN c)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(t: Tables) -> DataFrame:
    asked = search.centroids(t.embeddings, "label", "embedding")
    hits = search.vector_topk(asked, "label", "embedding", t.embeddings, "vec_id", "embedding", 10)
    return hits.withColumn("score", F.round("score", 4))


@query("vector_mmr", f"""
WITH RECURSIVE {CENTROIDS},
s AS (SELECT CAST(c.label AS BIGINT) AS query_id, v.vec_id AS doc_id, v.embedding AS e,
    round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.m), 6) AS score FROM embeddings v CROSS JOIN c),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 10),
alike AS (SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS sim
  FROM pool a JOIN pool b USING (query_id)),
g AS (SELECT query_id, doc_id, score, 1 AS rank, [doc_id] AS picked FROM pool WHERE place = 1
  UNION ALL
  SELECT query_id, doc_id, score, rank + 1, list_append(picked, doc_id) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * score - 0.5 * most, 9) DESC, place) AS best FROM (
      SELECT g.query_id, g.rank, g.picked, p.doc_id, p.score, p.place, max(m.sim) AS most
      FROM g JOIN pool p ON p.query_id = g.query_id AND NOT list_contains(g.picked, p.doc_id)
      JOIN alike m ON m.query_id = g.query_id AND m.a = p.doc_id AND list_contains(g.picked, m.b)
      WHERE g.rank < 5 GROUP BY ALL)) WHERE best = 1)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM g""")
def vector_mmr(t: Tables) -> DataFrame:
    asked = search.centroids(t.embeddings, "label", "embedding")
    hits = search.vector_mmr(asked, "label", "embedding", t.embeddings, "vec_id", "embedding")
    return hits.withColumn("score", F.round("score", 4))


ANY_WORD = " OR ".join(f"contains(lower(text), '{w}')" for w in QUESTION.split())
LONG_WORD = " OR ".join(f"contains(lower(x), '{w}')" for w in QUESTION.split() if len(w) > 3)


@query("vector_index_topk")
def vector_index_topk(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 100 against an index of all; without SQL, as an index may miss a neighbour."""
    index = search.vector_index(t.embeddings, "vec_id", "embedding")
    return search.vector_index_topk(t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", index, 10)


@query("keyword_search", f"""
SELECT doc_id, CAST(length(text) AS INT) AS length FROM documents WHERE {ANY_WORD} ORDER BY doc_id LIMIT 5""")
def keyword_search(t: Tables) -> DataFrame:
    return search.keyword_search(t.documents, "doc_id", "text", QUESTION)


@query("keyword_lines", f"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {LONG_WORD})[1:10] AS f FROM documents)
SELECT doc_id, generate_subscripts(f, 1) AS line_rank, trim(unnest(f)) AS line FROM l""")
def keyword_lines(t: Tables) -> DataFrame:
    return search.keyword_lines(t.documents, "doc_id", "text", QUESTION)


@query("conv_last_turns", """
SELECT conv_id, turn, role, text FROM (SELECT *, max(turn // 2) OVER (PARTITION BY conv_id) AS last FROM conversations)
WHERE turn // 2 > last - 2""")
def conv_last_turns(t: Tables) -> DataFrame:
    return search.last_turns(t.conversations, "conv_id", "turn", 2).select("conv_id", "turn", "role", "text")


@query("flag_external", f"""
SELECT conv_id, turn, regexp_matches(lower(text), '{"|".join(fixed.RESEARCH_TERMS)}') AS external FROM conversations""")
def flag_external(t: Tables) -> DataFrame:
    return search.flag_external(t.conversations, "text").select("conv_id", "turn", "external")


def links_sql(title: str) -> str:
    """The first five links of each page that have a title; ``title`` is SQL over the raw title."""
    return rf"""
WITH a AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '<[aA]\s', chr(1), 'g'), chr(1))[2:],
    lambda x: {{'link': trim(regexp_extract(string_split(x, '>')[1], 'href="([^"]*)"', 1)), 'raw': string_split(regexp_extract(x, '(?s)>(.*)', 1), '</a>')[1]}}),
    lambda x: x.link <> '')[1:5] AS links FROM pages),
u AS (SELECT page_id, generate_subscripts(links, 1) AS i, unnest(links).link AS link, unnest(links).raw AS raw FROM a),
r AS (SELECT page_id, i, link, trim(regexp_replace(regexp_replace({title}, '(?s)<.*?>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank, link, title, '' AS snippet FROM r WHERE title <> ''"""


# The entities that occur in markup; the operator itself knows all of them.
DECODED = "replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_links", links_sql("raw"))
def page_links(t: Tables) -> DataFrame:
    return pages.page_links(t.pages, "page_id", "html", entities=False)


@query("page_links_clean", links_sql(DECODED))
def page_links_clean(t: Tables) -> DataFrame:
    return pages.page_links(t.pages, "page_id", "html")
