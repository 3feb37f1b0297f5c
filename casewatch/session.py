"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# One report id can hold a large share of all rows. Spark only splits such a join partition when that
# costs no further shuffle, unless forced; aggregates above the join combine map-side, so the extra
# shuffle is small next to one task holding the hot key.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Reports are sorted and made distinct by case in the stage that joins them, where a task takes up to forty times the
# compressed bytes it reads. Small pieces keep that in bounds: AQE joins pieces up to the advisory size but splits none
# that is too large, so the number of pieces before it follows the stored bytes of the reports.
REPORT_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
LEAST_PIECES, STORED_BYTES_A_PIECE = 400, 4 << 20


def pieces_for(stored_bytes: int) -> int:
    """Number of shuffled pieces that grows with the stored bytes, so that a piece does not."""
    return max(LEAST_PIECES, -(-stored_bytes // STORED_BYTES_A_PIECE))


def stored_bytes(df: DataFrame) -> int:
    """Size of the files a table is read from, as Spark's reader has listed them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tune(spark: SparkSession, reports: DataFrame | None = None) -> SparkSession:
    """Apply the runtime SQL settings the plans rely on, with the stored `reports` also the sizes of their pieces;
    executors and memory stay the caller's."""
    settings = dict(RUNTIME_SETTINGS)
    if reports is not None:
        number = pieces_for(stored_bytes(reports))
        settings |= REPORT_SETTINGS | {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(number)}
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a local master, where driver and executors are one process, may do without: it gets a temporary folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = configured or spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casewatch-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once; later jobs re-read it even after executors are lost."""
    spark = df.sparkSession
    directory = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, keeps column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
