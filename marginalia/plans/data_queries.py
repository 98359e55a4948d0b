"""Queries of the general data-processing operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.moments import found_moments
from marginalia.operators.orphans import found_orphans
from marginalia.operators.packed import found_items
from marginalia.plans import oracle_data
from marginalia.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value packed in the tags and list-like fields of notes."""
    return found_items(table(spark, sf_dir, "notes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moment each notes.created and cache_metadata.cached_at names."""
    notes, cache = table(spark, sf_dir, "notes"), table(spark, sf_dir, "cache_metadata")
    return found_moments([("notes", notes, "note_id", "created"), ("cache_metadata", cache, "cache_id", "cached_at")], table(spark, sf_dir, "vaults"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to files that aren't live at the reference's time."""
    return found_orphans(*[table(spark, sf_dir, t) for t in ("parsed_links", "resolutions", "canvas_nodes", "vault_files", "hub_files")])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, month and state."""
    return p6_found(spark, sf_dir).groupBy("tbl", "ref_month", "state").agg(F.count(F.lit(1)).alias("refs"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_report": p6_report}
ORACLES = {
    "p6_found": oracle_data.P6_FOUND,
    "p6_report": f"SELECT tbl, ref_month, state, count(*) AS refs FROM ({oracle_data.P6_FOUND}) GROUP BY ALL",
}
