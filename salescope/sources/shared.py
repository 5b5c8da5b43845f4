"""Tables written to the cluster's shared folder for several queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one beside the warehouse's tables."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return path or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once for the length of a ``with`` block, which owns the folder and removes it.

    Queries on the yielded scan must end inside the block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
