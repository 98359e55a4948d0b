"""Queries of the text operators over the driver's tables, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.mixing import mix_report, select_mix
from marginalia.llm.neardup import found_pairs, near_groups
from marginalia.llm.pages import found_noise, repaired_pages
from marginalia.llm.residue import found_residue
from marginalia.llm.tokens import with_ids
from marginalia.llm.unify import canonical_forms, found_disguises
from marginalia.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines of scanned pages: headers, page numbers, cut words, misread words."""
    return found_noise(table(spark, sf_dir, "ref_pages"), table(spark, sf_dir, "cache_metadata"))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return repaired_pages(table(spark, sf_dir, "ref_pages"), table(spark, sf_dir, "cache_metadata"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of notes with similarity of content of at least 0.7 over runs of three words."""
    return found_pairs(table(spark, sf_dir, "notes"), "note_id", "content")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of nearly equal notes each note belongs to, and its number of links."""
    return near_groups(table(spark, sf_dir, "notes"), "note_id", "content").withColumnRenamed("id", "note_id")


def _p5_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("ref_pages", table(spark, sf_dir, "ref_pages"), "page_id", "text"), ("search_results", table(spark, sf_dir, "search_results"), "result_id", "snippet")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of disguised characters in each page text and snippet."""
    return found_disguises(_p5_sources(spark, sf_dir))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every page text and snippet that differs from its original."""
    return canonical_forms(_p5_sources(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return with_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, repeats, target and actual share of each source of the mix."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(select_mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", targets), targets)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, the source each stands for and how often it is used."""
    return select_mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue, stand-in text, error pages or script notices."""
    return found_residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that stay once those of p9_found are excluded."""
    return table(spark, sf_dir, "documents").select("doc_id").join(p9_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {"p1_found": p1_found, "p1_pages": p1_pages, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_canonical": p5_canonical, "p7_ids": p7_ids, "p8_shares": p8_shares, "p8_selection": p8_selection, "p9_found": p9_found, "p9_kept": p9_kept}

P4_FOUND = r"""
WITH words AS (SELECT DISTINCT note_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM notes WHERE content IS NOT NULL),
runs AS (SELECT DISTINCT note_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT note_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3)),
sizes AS (SELECT note_id, count(*) AS n FROM runs GROUP BY 1),
shared AS (SELECT a.note_id AS x, b.note_id AS y, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.note_id < b.note_id GROUP BY 1, 2)
SELECT x AS note_id_a, y AS note_id_b FROM shared JOIN sizes p ON p.note_id = x JOIN sizes q ON q.note_id = y WHERE 10 * c >= 7 * (p.n + q.n - c)
"""
ORACLES = {"p4_found": P4_FOUND}
