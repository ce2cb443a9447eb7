"""Tables in the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session that is one process may lack it and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders that this driver has made and not yet deleted.
_folders: dict[str, SparkSession] = {}


class Tables:
    """Intermediate tables of one job. ``drop`` deletes them when what reads them is no longer wanted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0
        _folders[self.folder] = spark

    def settled(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df``, written (in folders of the values of ``by``) and read back."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _folders.pop(folder, None)


def release() -> None:
    """Delete all intermediate tables that this driver has made: for when results that read them are written."""
    for folder, spark in list(_folders.items()):
        _delete(spark, folder)
