"""Tables between the steps of a plan, and joins that keep null keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session gets one of its own where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the lineage ends in a copy that outlives any executor.

    The table stays until the owner of the folder deletes it.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where null equals null; the columns of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__same_{k}" for k in keys])
