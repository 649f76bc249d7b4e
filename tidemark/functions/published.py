"""Tables that grow by whole batches: a batch is written to a folder of its own and then published by one row, so a reader
sees all of it or nothing, and what a failed job wrote is never read."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_DONE = "__batch string, __at long"


def there(spark: SparkSession, path: str) -> bool:
    """Whether anything was published under ``path``, in whatever store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(df: DataFrame, path: str, *by: str) -> None:
    """Add a batch, in folders by the columns ``by``."""
    batch = f"b{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{path}/rows/__batch={batch}")
    df.sparkSession.createDataFrame([(batch, time.time_ns())], _DONE).coalesce(1).write.mode("append").parquet(f"{path}/done")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all published batches, with ``__at``, which orders batches. Folder names keep the types of ``schema``."""
    whole = StructType([*schema.fields, StructField("__batch", StringType())])
    if not there(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("__at", LongType())]))
    done = F.broadcast(spark.read.schema(_DONE).parquet(f"{path}/done"))  # a row a batch
    return spark.read.schema(whole).parquet(f"{path}/rows").join(done, "__batch").drop("__batch")
