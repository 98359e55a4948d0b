"""The background refresh of the text cache as an incremental job.

The stream tells which references were touched since the last run (``availableNow``); these are rebuilt from all their pages,
so a reference whose pages arrive in several batches, or again, has one whole entry. The cache is partitioned by a hash of
the path and only touched partitions are rewritten. State is only the checkpoint of files already seen, and a batch that
runs twice writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marginalia.operators.references import marked_text
from marginalia.session import cut

PAGES = "path string, page int, label string, text string"


def refresh_cache(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint_dir: str, schema: str = PAGES, buckets: int = 64) -> StreamingQuery:
    """Rebuilds the page-marked text (path, kind, content) of references whose pages arrived as Parquet files since the last run.

    Of a page that arrived several times the newest file's row counts.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")

    def build(batch: DataFrame, _: int) -> None:
        touched = cut(batch.where("path is not null").select("path").distinct())
        if touched.isEmpty():
            return
        every = spark.read.schema(schema).parquet(pages_dir).select("path", "page", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_at"), F.struct("label", "text").alias("_row"))
        pages = every.join(touched, "path", "left_semi").groupBy("path", "page").agg(F.max_by("_row", "_at").alias("_row")).select("path", "page", "_row.*")
        new = marked_text(pages).select("path", "kind", "content", bucket)
        try:
            old = spark.read.parquet(out_dir).select("path", "kind", "content", bucket)
        except Exception as e:  # the first run
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            beside = old.join(touched.select(bucket).distinct(), "bucket", "left_semi").join(touched, "path", "left_anti")
            new = new.unionByName(beside.select(*new.columns))
        # Written first, as the partitions that are read are the ones replaced.
        cut(new).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out_dir)

    stream = spark.readStream.schema(schema).parquet(pages_dir)
    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
