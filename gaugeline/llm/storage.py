"""Where operators put intermediate results: the folder all executors share, as the session names it in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a narrow table that is broadcast; larger ones are joined by a shuffle, with adaptive skew handling.
SMALL_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, as a URI. Only where it is unset and all of Spark is one process, as in tests, a folder of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor costs a reread and no recomputation."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, through the file system that Spark itself uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Tables of one operator's run that nothing needs once its result is written: they are deleted when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def folder(self, name: str) -> str:
        self.folders.append(work_folder(self.spark, name))
        return self.folders[-1]

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """As keep(); ``by``: a column whose values get folders of their own."""
        folder = self.folder(name)
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for folder in self.folders:
            discard(self.spark, folder)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count of the (written) table shows SMALL_ROWS rows at most, else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path; runs on executors too."""
    return pafs.FileSystem.from_uri(uri)
