"""Source files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of code files.
SUFFIXES = ("sas", "py", "R", "r", "bas", "vba", "cls", "txt")


def read_code(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(filename, content) of the files below ``path`` with these suffixes; each is one row. Bytes that
    are no UTF-8 become replacement characters."""
    glob = "*.{" + ",".join(suffixes) + "}"
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)  # as options they would be reset
    return df.select(F.col("_metadata.file_name").alias("filename"), F.make_valid_utf8("value").alias("content"))
