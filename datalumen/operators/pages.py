"""Links with title and snippet from raw pages."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalumen.functions.columns import col, strip

# Class names of result links and of the snippet block after them.
RESULT_CLASS = "result-link|result-link--title|result__a"
SNIPPET_CLASS = "result-snippet|snippet|result__snippet"

# One anchor with its text and, if one follows at once, the block after it.
ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a\s*>(?:\s*<(div|span)\b([^>]*)>(.*?)</\3\s*>)?"
BLANK = r"(?i)&(nbsp|#160|#xa0);"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in whatever place and quotes it stands; empty if there is none."""
    value = F.regexp_extract(tag, rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.translate(value, "\"'", ""))


def bare_text(c: Column) -> Column:
    """Text without tags, white space folded."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<.*?>", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def plain_text(raw: pd.Series) -> pd.Series:
    """As ``bare_text`` with character entities resolved first, which Spark has no function for."""
    return raw.map(lambda s: re.sub(r"\s+", " ", re.sub(r"<.*?>", " ", html.unescape(s or ""))).strip())


def _links(page: Column) -> Column:
    """Every anchor with an address, in page order; the page is matched once, the parts are read from each match."""

    def parts(found: Column) -> Column:
        tag, title, block, snippet = (F.regexp_extract(found, ANCHOR, g) for g in (1, 2, 4, 5))
        result = F.lower(_attribute(tag, "class")).rlike(RESULT_CLASS)
        after = F.lower(_attribute(block, "class")).rlike(SNIPPET_CLASS)
        return F.struct(_attribute(tag, "href").alias("link"), title.alias("title"), result.alias("result"),
                        F.when(result & after, snippet).otherwise("").alias("snippet"))

    return F.filter(F.transform(F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(0)), parts), lambda r: r["link"] != "")


def page_links(pages: DataFrame, key: str, page: str, most: int = 5, entities: bool = True) -> DataFrame:
    """Up to ``most`` links per page: result links if there are any, else the first links of any kind.

    All matching stays inside the row, so pages are never shuffled.
    """
    def titled(r: Column) -> Column:
        return bare_text(F.regexp_replace(r["title"], BLANK, " ")) != ""

    both = pages.select(col(key), _links(col(page)).alias("_all"))
    results = F.slice(F.filter(F.slice(F.filter("_all", lambda r: r["result"]), 1, 3 * most), lambda r: titled(r)
                               & ~r["link"].startswith("javascript:")), 1, most)
    plain = F.transform(F.filter(F.slice("_all", 1, most), titled), lambda r: r.withField("snippet", F.lit("")))
    both = both.withColumn("_results", results).withColumn(
        "_links", F.when(F.size("_results") > 0, F.col("_results")).otherwise(plain))
    rows = both.select(col(key), F.posexplode("_links").alias("_pos", "_r"))
    clean = plain_text if entities else bare_text
    return rows.select(
        col(key), (F.col("_pos") + 1).cast("bigint").alias("rank"), F.col("_r.link").alias("link"),
        clean(F.col("_r.title")).alias("title"), clean(F.col("_r.snippet")).alias("snippet"))
