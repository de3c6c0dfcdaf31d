"""License notices by diagonal voting, in DataFrame operations alone.

The hashes of all rolling word ``K``-grams of the documents are joined to the positions of the same grams in the notice
templates. Matches with one difference of positions lie on a diagonal; votes are aggregated by document, template and diagonal,
diagonals at most ``GAP`` apart are merged (inserted or missing words), and the merged span is verified: enough of
the template's words are covered, all words that decide (the name, the version) are among them, and the span is not stretched. Where verified
spans overlap, each word goes to the span that matches most words, and a span that keeps less than half of its words goes: a notice that
another one contains, or nearly equals, gives no label. Fixed phrases are found beside that as whole word runs.

Null and empty texts have no words and score 0. Repeated rows each get the same result. Words are cut once; very long texts become one
row per word. The templates are a fixed, small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalumen.llm.common import documents, key
from datalumen.session import checkpointed

K, GAP, COVERED, STRETCH = 3, 3, 0.75, 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GPL_HEADER = ("is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by "
               "the free software foundation either version {1} of the license or at your option any later version")
_AS_IS = "{0} is provided {1} as is {2}without warranty of any kind express or implied including but not limited to the warranties of"
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met {0}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "{1}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution {2}this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed")
_NO_ENDORSEMENT = ("3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission ")

# The labels that the voting adds, notices as words, and the words of a notice that have to be there.
TEMPLATES = [
    ("agpl-3.0", "this program " + _GPL_HEADER.format("affero ", 3), ["affero general public license", "version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                   "you may obtain a copy of the license at", ["apache license version 2"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied see the license for the specific language "
                   "governing permissions and limitations under the license", ["software distributed under the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ["source and binary forms", "conditions are met"]),
    ("bsd-2-clause", _BSD.format("1 ", "2 ", ""), ["redistributions in binary form"]),
    ("bsd-3-clause", _BSD.format("1 ", "2 ", _NO_ENDORSEMENT), ["redistributions in binary form", "neither the name of"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
     ["person or organization", "accompanying documentation covered"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "this program " + _GPL_HEADER.format("", 2), ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "this program " + _GPL_HEADER.format("", 3), ["gnu general public license", "version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies", ["with or without fee"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl-2.1", "this library " + _GPL_HEADER.format("lesser ", "2 1"), ["lesser general public license", "version 2 1"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["lesser general public license version 2 1"]),
    ("lgpl-3.0", "this library " + _GPL_HEADER.format("lesser ", 3), ["lesser general public license", "version 3"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license version 3"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files", ["obtaining a copy"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                   "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                   "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
                   "do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
                   "copies or substantial portions of the software " + _AS_IS.format("the software", "", "").replace("  ", " ")
                   + " merchantability fitness for a particular purpose and noninfringement", ["to deal in the software without restriction"]),
    ("mit-notice", "released under the mit license", ["the mit license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
                  "or distribute this software", ["unencumbered software", "public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
             "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
             "applications and to alter it and redistribute it freely", ["authors be held liable", "redistribute it freely"]),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _grams(of: str) -> Column:
    return F.when(F.size(of) >= K, F.transform(F.sequence(F.lit(0), F.size(of) - K), lambda i: F.xxhash64(F.slice(of, i + 1, K))))


def _deciding(notice: list[str], phrases: list[str]) -> list[int]:
    """The places in a notice of the phrases that have to be there."""
    out = set()
    for phrase in (p.split(" ") for p in phrases):
        at = next(i for i in range(len(notice)) if notice[i:i + len(phrase)] == phrase)
        out.update(range(at, at + len(phrase)))
    return sorted(out)


def _templates() -> list[tuple[int, str, list[str], list[int]]]:
    cut = [(label, notice.split(" "), phrases) for label, notice, phrases in TEMPLATES]
    return [(i, label, notice, _deciding(notice, phrases)) for i, (label, notice, phrases) in enumerate(cut)]


def templates(spark) -> DataFrame:
    """``template, place, gram`` of the notices; as many rows as they have words."""
    frame = spark.createDataFrame([(i, notice) for i, _, notice, _ in _templates()], "template int, words array<string>")
    return frame.select("template", F.posexplode(_grams("words")).alias("place", "gram"))


def template_facts(spark) -> DataFrame:
    """``template, label, length, deciding`` of the notices, one row each."""
    rows = [(i, label, len(notice), deciding) for i, label, notice, deciding in _templates()]
    return spark.createDataFrame(rows, "template int, label string, length int, deciding array<int>")


def _phrase_places(phrase: str) -> Column:
    """Where a phrase's words stand in ``words``, from 0."""
    parts = phrase.split(" ")
    candidates = F.sequence(F.lit(0), F.size("words") - len(parts))

    def here(i: Column) -> Column:
        test = F.get("words", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get("words", i + k) == part)
        return test

    return F.when((F.size("words") >= len(parts)) & F.array_contains("words", parts[-1]), F.filter(candidates, here)).otherwise(
        F.array().cast("array<int>"))


def votes(docs: DataFrame) -> DataFrame:
    """The matches ``row_key, at, template, place`` of all documents, and one row with ``at`` of -1 for each document.

    The latter hold ``doc_id, n_words, n_base, first_word, last_word, found``, ``found`` the labels of the phrases.
    """
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "found"]
    names = [f"places_{i}" for i in range(len(PHRASES))]
    cut = docs.select("doc_id", "row_key", words().alias("words"))
    placed = cut.select("doc_id", "row_key", "words", *[_phrase_places(p).alias(n) for p, n in zip(PHRASES, names)])
    every = F.concat(*names)
    facts = placed.select(
        "doc_id", "row_key", F.size("words").cast("bigint").alias("n_words"), F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(n) > 0, label) for n, label in zip(names, PHRASES.values())])).alias("found"),
        F.coalesce(_grams("words"), F.array().cast("array<bigint>")).alias("grams"))
    # A gram that is null matches nothing and stands for the document itself.
    each = facts.select(*own, "row_key", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), "grams")).alias("at", "gram"))
    met = each.join(F.broadcast(templates(docs.sparkSession)), "gram", "left").where((F.col("at") == 0) | F.col("template").isNotNull())
    return met.select("row_key", (F.col("at") - 1).alias("at"), "template", "place", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in own])


def notices(voted: DataFrame) -> DataFrame:
    """``row_key, span, label, start, stop, matched, covered, verified``: the merged spans that any template votes for, in words."""
    by_diagonal = voted.where("template is not null").groupBy("row_key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("start"), (F.max("at") + K).alias("stop"))
    along = Window.partitionBy("row_key", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(along) > GAP).cast("int")
    grouped = by_diagonal.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("part", F.sum("new").over(along))
    spans = grouped.groupBy("row_key", "template", "part").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.join(F.broadcast(template_facts(voted.sparkSession)), "template").withColumn(
        "reached", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    matched = F.size("reached")
    covered = matched / F.col("length")
    return spans.select(
        "row_key", F.struct("template", "part").alias("span"), "label", "start", "stop", matched.alias("matched"), covered.alias("covered"),
        ((covered >= COVERED) & (F.size(F.array_except("deciding", "reached")) == 0)
         & (F.col("stop") - F.col("start") <= F.col("length") * STRETCH)).alias("verified"))


def best_labels(found: DataFrame) -> DataFrame:
    """``row_key, label`` of the verified spans that keep half of their words, each word going to the span that matches most."""
    each = found.where("verified").select(
        "row_key", "span", "label", (F.col("stop") - F.col("start")).alias("width"), F.struct("matched", "covered", "label").alias("rank"),
        F.explode(F.sequence("start", F.col("stop") - 1)).alias("word"))
    best = F.max("rank").over(Window.partitionBy("row_key", "word"))
    kept = each.withColumn("own", (F.col("rank") == best).cast("int")).groupBy("row_key", "span", "label", "width").agg(F.sum("own").alias("own"))
    return kept.where("own * 2 >= width").select("row_key", "label").distinct()


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    The score is 1 with a phrase, or else the largest share of a template that a span covers.
    """
    voted = checkpointed(votes(key(documents(docs))))
    found = checkpointed(notices(voted))
    labels = best_labels(found).groupBy("row_key").agg(F.collect_set("label").alias("added"))
    most = found.groupBy("row_key").agg(F.max("covered").alias("covered"))
    added = checkpointed(most.join(labels, "row_key", "left"))
    rows = voted.where("at = -1").join(added, "row_key", "left")
    labels = F.array_distinct(F.concat("found", F.coalesce("added", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"))


def _sql() -> str:
    """The report as plain SQL, with grams as text."""
    def values(rows):
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

    grams, facts = [], []
    for t, label, notice, deciding in _templates():
        grams += [(t, p, " ".join(notice[p:p + K])) for p in range(len(notice) - K + 1)]
        facts.append((t, label, len(notice), deciding))
    return f"""
WITH phrases(phrase, label) AS (VALUES {values(PHRASES.items())}),
templates(template, place, gram) AS (VALUES {values(grams)}),
facts(template, label, length, deciding) AS (VALUES {values(facts)}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
n AS (SELECT r, pos, word || ' ' || lead(word, 1) OVER x AS g2, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x AS g3,
        word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x AS g4
      FROM w WINDOW x AS (PARTITION BY r ORDER BY pos)),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS found
      FROM n JOIN phrases ON phrase = g2 OR phrase = g4 GROUP BY r),
v AS (SELECT DISTINCT r, template, pos - place AS diagonal, pos, place FROM n JOIN templates ON gram = g3),
g AS (SELECT r, template, diagonal, list(place) AS places, min(pos) AS start, max(pos) + {K} AS stop FROM v GROUP BY ALL),
p AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {GAP} THEN 0 ELSE 1 END AS new FROM g WINDOW x AS (PARTITION BY r, template ORDER BY diagonal)),
q AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM p),
s AS (SELECT r, template, part, list_distinct(flatten(list_transform(flatten(list(places)), lambda x: range(x, x + {K})))) AS reached,
        min(start) AS start, max(stop) AS stop FROM q GROUP BY ALL),
c AS (SELECT *, len(reached) / length AS covered FROM s JOIN facts USING (template)),
e AS (SELECT r, template, part, label, stop - start AS width, len(reached) AS matched, covered, unnest(range(start, stop)) AS word FROM c
      WHERE covered >= {COVERED} AND len(list_filter(deciding, lambda x: NOT list_contains(reached, x))) = 0 AND stop - start <= length * {STRETCH}),
o AS (SELECT *, rank() OVER (PARTITION BY r, word ORDER BY matched DESC, covered DESC, label DESC) AS place FROM e),
k AS (SELECT r, label FROM o GROUP BY r, template, part, label, width HAVING 2 * count(*) FILTER (place = 1) >= width),
l AS (SELECT r, list(DISTINCT label) AS added FROM k GROUP BY r),
m AS (SELECT r, max(covered) AS covered FROM c GROUP BY r),
a AS (SELECT r, added, covered FROM m LEFT JOIN l USING (r))
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(added, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(covered, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""


SQL = _sql()
