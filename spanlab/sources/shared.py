"""Files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a cluster gets a folder in the warehouse, which its members share as they share tables; only where driver and
    executors are one process (master ``local``) is it a temporary folder of the machine. A cluster whose warehouse is a local folder is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="spanlab-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/spanlab-checkpoints"
        if not alone and found.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is on each machine's own disk")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing uses yet."""
    return f"{shared_dir(spark)}/spanlab-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to that folder and read back: what is used several times is made once, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
