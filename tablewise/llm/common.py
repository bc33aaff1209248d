"""Shared plumbing: tables, the shared folder, and Arrow batches."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that a worker handles at once. Spark bounds what it sends by
#: bytes (spark.sql.execution.arrow.maxBytesPerBatch); a longer row comes alone.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 1000

#: Name prefix of internal columns.
OWN = "__tw_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tablewise_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    at = os.path.join(tempfile.mkdtemp(prefix="tablewise-"), "tablewise-package.zip")
    Path(at).write_bytes(packed.getvalue())
    sc.addPyFile(at)
    sc._tablewise_shipped = True


def sliced(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batches in slices of at most ``rows`` rows and of about ``size`` bytes."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it
    is unset, a temporary one serves in local mode only; a cluster's machines don't
    share theirs, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tablewise-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    """A path in this application's part of the shared folder. That part is deleted
    when the driver's JVM ends, since what a caller still reads can't be told earlier."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/tablewise-{sc.applicationId}"
    if getattr(sc, "_tablewise_folder", None) != top:
        fs, p = _hadoop(spark, top)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._tablewise_folder = top
    return f"{top}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back. Cuts the
    lineage, survives lost executors, and later readers prune its columns, and its
    folders of one value of ``by`` each."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialise`` returned and no one reads
    any more."""
    spark = df.sparkSession
    folder = df.inputFiles()
    if folder:
        at = folder[0]
        fs, p = _hadoop(spark, at[: at.rindex("/")])
        fs.delete(p, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whatever their case, so that results can be added."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x
