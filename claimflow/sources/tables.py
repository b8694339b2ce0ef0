"""Tables, dataset projections, snapshots, versions and CSV export."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow import schemas


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


DATASET_CLAIMS = [c for c in schemas.names(schemas.CLAIMS) if c != "description"]
DATASET_RISK = schemas.names(schemas.COUNTRY_RISK)


def dataset_claims(claims: DataFrame) -> DataFrame:
    """The nineteen columns offered to reporting."""
    return claims.select(*DATASET_CLAIMS)


def dataset_risk(risk: DataFrame) -> DataFrame:
    return risk.select(*DATASET_RISK)


def register_views(datasets: dict[str, DataFrame]) -> None:
    """Offer datasets to Spark SQL under their names; they are computed when queried."""
    for name, df in datasets.items():
        df.createOrReplaceTempView(name)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table version and read it back. The path must not be one that `df` reads."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


VERSIONS = "version bigint, folder string"


def _newest_version(spark: SparkSession, root: str):
    return spark.read.schema(VERSIONS).json(f"{root}/versions").orderBy(F.desc("version"), "folder").first()


def read_version(spark: SparkSession, root: str, schema) -> DataFrame:
    """The committed version of a table."""
    return spark.read.schema(schema).parquet(f"{root}/{_newest_version(spark, root)['folder']}")


def write_version(df: DataFrame, root: str, first: bool = False) -> DataFrame:
    """Commit the next version of a table and read it back. One writer at a time.

    The rows go to a new folder, and the record that names it is written last, so a version is
    seen whole or not at all, and `df` may read the version before. `first` starts the table.
    """
    spark = df.sparkSession
    number = 0 if first else _newest_version(spark, root)["version"] + 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    record = spark.range(1).select(F.lit(number).cast("bigint").alias("version"), F.lit(folder).alias("folder"))
    record.write.mode("errorifexists" if first else "append").json(f"{root}/versions")
    return spark.read.schema(df.schema).parquet(f"{root}/{folder}")


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Store a table in buckets of a key, so that later joins on the key leave it in place.

    Worth its one shuffle for the claims table, which every write-back joins on the claim id.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def export_csv(df: DataFrame, condition: Column | str, path: str) -> None:
    """Rows that meet a condition, as CSV files with a header. Line ends in text are kept by quoting."""
    df.filter(condition).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
