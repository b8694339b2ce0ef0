"""A claims table kept by hash bucket, whose write-backs replace the touched buckets alone."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.functions import scalars as fn
from claimflow.operators import decisions

BUCKETS = 64
# The number of the decision that a claim has, by which an older one is told.
LAST = "decimal(38,0)"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, mode: str) -> None:
    """One or more files per bucket; large buckets are split by the size of what they hold."""
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "claim_id")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/rows")


def create(claims: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Store claims below `root`. `last`, the decision a claim has from here on, starts empty."""
    last = F.lit(None).cast(LAST)
    _write(claims.withColumn("last", last).withColumn("bucket", bucket(F.col("claim_id"), buckets)), root, "errorifexists")
    spark = claims.sparkSession
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{root}/layout")


def _layout(spark: SparkSession, root: str) -> int:
    return spark.read.schema("buckets int").json(f"{root}/layout").first()["buckets"]


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as it stands, without what only the write-back needs."""
    return spark.read.parquet(f"{root}/rows").drop("last", "bucket")


def by_id(spark: SparkSession, root: str, claim_id: str) -> DataFrame:
    """One claim; only its bucket's files are opened."""
    key = F.lit(claim_id)
    own = spark.range(1).select(bucket(key, _layout(spark, root))).first()[0]
    return spark.read.parquet(f"{root}/rows").filter((F.col("bucket") == own) & (F.col("claim_id") == key)).drop("last", "bucket")


def apply(spark: SparkSession, root: str, made: DataFrame) -> list[int]:
    """Write decisions back into the stored claims; the numbers of the buckets that were replaced.

    A claim takes the newest decision it has seen, whatever the order in which decisions come: an older
    one, or the same again, changes nothing, so a write-back that is repeated after a failure does
    no harm. Only buckets with a decided claim are read and written; the others' files stay. The
    new files are complete before any old one is removed; one writer at a time.
    """
    buckets = _layout(spark, root)
    # Every claim with a decision has a newest one, so the claim ids alone tell the buckets, without a join. At most
    # as many numbers as there are buckets reach the driver.
    asked = made.filter(F.col("claim_id").isNotNull()).select(bucket(F.col("claim_id"), buckets).alias("bucket"))
    touched = sorted(r[0] for r in asked.distinct().collect())
    if not touched:
        return []
    found = decisions.newest_numbered(made)
    stored = spark.read.parquet(f"{root}/rows").filter(F.col("bucket").isin(touched))
    joined = stored.alias("c").join(found.alias("d"), F.col("c.claim_id") == F.col("d.claim_id"), "left")
    hit = F.col("d.claim_id").isNotNull() & (F.col("c.last").isNull() | (F.col("d.number") > F.col("c.last")))
    text = F.coalesce("d.accepted", F.to_json(F.struct(*[F.col(f"d.{c}").alias(c) for c in ("decision", "risk_score", "recommended_payout", "reasoning")])))
    new = {
        "ai_decision": F.when(hit, F.coalesce("d.decision", "c.ai_decision")).otherwise(F.col("c.ai_decision")),
        "ai_reasoning": F.when(hit & F.col("d.decision").isNotNull(), text).otherwise(F.col("c.ai_reasoning")),
        "status": F.when(hit & F.col("d.decision").isNotNull(), fn.decision_to_status(F.col("d.decision"))).otherwise(F.col("c.status")),
        "last": F.when(hit, F.col("d.number")).otherwise(F.col("c.last")),
    }
    _write(joined.select(*[new.get(c, F.col(f"c.{c}")).alias(c) for c in stored.columns]), root, "overwrite")
    return touched
