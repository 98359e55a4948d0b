"""Keyword search over notes and over page-marked text of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import text as X
from marginalia.operators.notes import parsed

#: What a title that holds a term adds to the score, for each listing of the term.
TITLE_BOOST = 5


def _all_terms(low: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [low.contains(t) for t in dict.fromkeys(terms)])


def _score(low: Column, title: Column, terms: list[str]) -> Column:
    """Occurrences of every listed term in the text, plus the boost for each in the title; a repeated term counts again."""
    parts = [X.occurrences(low, t) + F.when(title.contains(t), TITLE_BOOST).otherwise(0) for t in terms]
    return reduce(lambda a, b: a + b, parts).cast("double")


def search_notes(notes: DataFrame, query: str, max_results: int = 20) -> DataFrame:
    """path, title, snippet, score of the notes whose content holds every term, best first, ties by path.

    Terms match as substrings regardless of case. A query without terms, or a limit below one, finds nothing. The filter
    runs on the scanned content before any note is parsed.
    """
    terms = X.query_terms(query)
    if not terms or max_results < 1:
        return parsed(notes.where(F.lit(False))).select("path", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("score"))
    hits = notes.where(_all_terms(F.lower("content"), terms))
    hits = parsed(hits).withColumn("score", _score(F.lower("content"), F.lower("title"), terms))
    top = hits.select("path", "title", "content", "score").orderBy(F.desc("score"), "path").limit(max_results)
    return top.select("path", "title", X.search_snippet(F.col("content"), terms).alias("snippet"), "score")


def search_references(texts: DataFrame, query: str, max_results: int = 10, max_per_document: int = 3) -> DataFrame:
    """path, title, page, snippet, score over rows (path, title, part, content): page-marked texts or single pages.

    At most max_per_document rows of each document, then the best max_results. ``page`` is that of the first term's first
    occurrence by the markers in the text. Markers are text and match too.
    """
    terms = X.query_terms(query)
    if not terms or max_results < 1 or max_per_document < 1:
        texts, terms = texts.where(F.lit(False)), terms or ["--"]
    hits = texts.where(_all_terms(F.lower("content"), terms)).withColumn("score", _score(F.lower("content"), F.lower(F.coalesce("title", F.lit(""))), terms))
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "part"))
    top = hits.withColumn("_r", rank).where(F.col("_r") <= max_per_document).orderBy(F.desc("score"), "path", "part").limit(max(0, max_results))
    return top.select("path", "title", "part", X.page_of_match(F.col("content"), terms[0]).alias("page"), X.search_snippet(F.col("content"), terms).alias("snippet"), "score")


def pages_with(pages: DataFrame, term: str, most: int) -> DataFrame:
    """path, page: the first pages, in order, of each document that hold a term, at most so many of each."""
    hits = pages.where(F.lower("text").contains(term.lower())).select("path", "page").distinct()
    return hits.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy("page"))).where(F.col("_r") <= most).drop("_r")
