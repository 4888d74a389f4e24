"""Shared scratch space: where intermediate tables and checkpoints live.

On a cluster the folder is whatever ``spark.checkpoint.dir`` names.  Only a session that runs in one process
(tests, notebooks) may have none; it gets a folder of our own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; sets a local one only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loomql-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that nobody else uses."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep its rows in the shared folder and forget its lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a row group of stored tables: what a writer holds in memory.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**{"parquet.block.size": str(ROW_GROUP), **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows (counted), else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df
