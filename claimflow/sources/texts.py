"""Text files read whole, one row per file: inspection notes and policy documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
        .select(
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("value").alias("text"),
        )
    )


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    return read_whole_texts(spark, folder)


def read_policy_docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_whole_texts(spark, folder)
