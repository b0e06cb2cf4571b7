"""Small session helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share.

    A session in one process may go without that setting and gets a scratch folder; on a cluster it is an
    error, as executors share no local disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="claimcheck-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for results that many plans read: filters and columns reach its scan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a bounded count proves the side small, else leave it to AQE."""
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal rows out over all cores, and over so many tasks that one has at most about ``rows`` of them.

    Splits of files go by bytes and end at row groups, so one split can hold millions of short rows, and a split without a row
    group none; the work of a regex goes by rows. The count is read from the footers of the files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def one_long(df: DataFrame, column: str) -> int:
    """A single aggregate value (never a data set) brought to the driver."""
    row = df.agg(F.max(column).alias("v")).first()
    return int(row["v"]) if row and row["v"] is not None else 0


def local_session(cores: int = 8, shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimcheck")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
