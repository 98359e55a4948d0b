"""Session helpers shared by every operator: reading tables, bounded broadcasts, cutting lineage."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have at most before it is broadcast; beyond it the planner shuffles.
BROADCAST_ROWS = 200_000
#: Bytes such a side may have at most as written (columnar, compressed).
BROADCAST_BYTES = 8 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers there can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # Only the driver reads this file; Spark sends it on to the executors.
    path = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia.zip"
    path.write_bytes(content.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, read from Parquet so that pruning and push-down reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame) -> tuple[object, object]:
    """The Hadoop file system and path of a folder that ``cut`` wrote."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._cut_folder)
    return path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), path


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, written and read back, with a broadcast hint if it has at most max_rows rows and max_bytes bytes as written; else
    a hint for a sorted merge, so that no estimate makes a broadcast of it.

    The table is written once; rows are counted from the files' footers, so its plan doesn't run a second time.
    """
    kept = df if hasattr(df, "_cut_folder") else cut(df)
    fs, path = _files(kept)
    small = fs.getContentSummary(path).getLength() <= max_bytes and kept.count() <= max_rows
    return F.broadcast(kept) if small else kept.hint("merge")


def _is_local(master: str) -> bool:
    """Whether all tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder within the one the cluster names in spark.checkpoint.dir; a temporary one only where that is
    unset and all tasks run in the driver's own process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if named is None and not _is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder as Parquet and read back: later steps don't recompute it, read only the
    columns they need, and the planner knows its real size. The files go when the application ends."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    fs, path = _files(out)
    fs.deleteOnExit(path)
    return out


def utc_date(df: DataFrame, name: str) -> Column:
    """The UTC calendar date of a timestamp column, whatever the session's zone.

    A column without zone already holds UTC; a zoned one is cut from its microseconds since the epoch.
    """
    col = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.date_from_unix_date(F.floor(F.unix_micros(col) / F.lit(86_400_000_000)).cast("int"))
    return col.cast("date")


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column; a column without zone already holds UTC."""
    col = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(col)
    clock = F.hour(col) * 3600 + F.minute(col) * 60
    second = (F.extract(F.lit("SECOND"), col) * F.lit(1_000_000)).cast("bigint")
    return (F.unix_date(col.cast("date")).cast("bigint") * 86_400 + clock) * F.lit(1_000_000) + second
