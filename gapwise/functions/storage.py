"""Cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own only in local mode: executors elsewhere wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir isn't set; it has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="gapwise-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, made at once."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the checkpoint folder: columns compress, and readers take those they need only."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """The frame as a table in the checkpoint folder, in ``n`` buckets by a column: groups and joins by it need no shuffle, however often it is read."""
    spark = df.sparkSession
    name = f"gapwise_{uuid.uuid4().hex}"
    rows = df.repartition(n, key).sortWithinPartitions(key)
    rows.write.bucketBy(n, key).sortBy(key).option("path", f"{checkpoint_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)
