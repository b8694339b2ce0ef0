"""Session settings and shared scratch space."""

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "claimflow") -> SparkSession.Builder:
    """A session builder with the settings the operators are tuned for.

    Adaptive execution sizes the shuffle partitions, splits skewed join partitions (also where
    the split costs another exchange) and turns a join into a broadcast join once a side has
    been measured to be small.
    """
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Partitions of a small shuffle may be as small as this, so that its work is dealt to all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # The virtual machine does not compile longer methods; wide projections are then split instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites are not recorded for each column expression: plans build in half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the cluster's shared folder.

    The folder is named by spark.checkpoint.dir or was set as the checkpoint folder. A session on one
    machine may do without, and gets one in its warehouse; on a cluster, where a warehouse may be
    a folder of the driver's own, its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `scratch` named, once nothing reads it any more; no other folder."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    root, own = path_of(scratch(spark, "x")).getParent(), path_of(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.makeQualified(own.getParent()).equals(files.makeQualified(root)):
        files.delete(own, True)


def fixed_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as a local relation, so that its exact size is known to Catalyst."""
    columns = [list(values) for values in zip(*rows)]
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame(pa.table(dict(zip(names, columns))), schema)
