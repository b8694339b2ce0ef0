"""File-arrival streams: claim ingest and evaluation responses.

Both write through the parquet file sink with a checkpoint, which commits each input file
exactly once: a restart, or an executor lost half-way, adds nothing twice.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow import schemas
from claimflow.operators import decisions, kpis, notes
from claimflow.sources import buckets

MALFORMED = "_malformed"


def _read_json_stream(
    spark: SparkSession, schema: str, folder: str, files_per_batch: int | None, whole_files: bool = False
) -> DataFrame:
    reader = (
        spark.readStream.schema(f"{schema}, {MALFORMED} string")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("mode", "PERMISSIVE")
        .option("multiLine", whole_files)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_claims(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    schema: str = schemas.RAW_CLAIMS,
    files_per_batch: int | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Bring newly arrived claim files into the raw table.

    A file holds one JSON object per line or, with `whole_files`, one object over many lines.

    A record that does not parse stays in the table with its raw text in `_malformed`, so that
    nothing is lost; `raw_claims` and `malformed_claims` tell the two apart.
    """
    arrived = _read_json_stream(spark, schema, folder, files_per_batch, whole_files).withColumn(
        "source_file", F.col("_metadata.file_name")
    )
    _run_to_end(arrived, out, checkpoint)
    return spark.read.schema(arrived.schema).parquet(out)


def raw_claims(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col(MALFORMED).isNull()).drop(MALFORMED, "source_file")


def malformed_claims(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col(MALFORMED).isNotNull()).select("source_file", MALFORMED)


def log_decisions(
    spark: SparkSession, folder: str, log: str, checkpoint: str, files_per_batch: int | None = None
) -> DataFrame:
    """Parse newly arrived evaluation responses and append them to the decision log.

    A micro-batch writes its own decisions only. The wide claims table is not rewritten per
    batch; `current_claims` applies the log when the table is read. A record that does not parse,
    or whose time does not, stays in the log with its raw text in `_malformed` and is not applied;
    `malformed_decisions` lists such records.
    """
    arrived = _read_json_stream(spark, schemas.RAW_DECISIONS, folder, files_per_batch)
    parsed = decisions.parse_decisions(arrived).drop("response")
    _run_to_end(parsed, log, checkpoint)
    return spark.read.schema(parsed.schema).parquet(log)


def good_decisions(log: DataFrame) -> DataFrame:
    return log.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def malformed_decisions(log: DataFrame) -> DataFrame:
    return log.filter(F.col(MALFORMED).isNotNull()).select(MALFORMED)


def compact_decisions(spark: SparkSession, log: str, root: str, checkpoint: str) -> None:
    """Write the decisions that came into the log since the last call back into the stored claims.

    The log is itself read as a stream: the checkpoint keeps how far it has been applied, and what lies
    before is not read again. `root` is a table of `sources.buckets`, of which a batch replaces
    the touched buckets alone. The numbers of the batches written stand beside the table, by checkpoint. A
    batch that comes again, as after a failure between the write and the commit, is told by its number
    and left out, and would change nothing if it were not: a claim has the newest decision it has seen.
    """

    def write_back(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if number <= applied_batch(session, root, checkpoint):
            return
        buckets.apply(session, root, good_decisions(batch))
        done = session.range(1).select(F.lit(checkpoint).alias("stream"), F.lit(number).cast("bigint").alias("batch"))
        done.coalesce(1).write.mode("append").json(f"{root}/applied")

    schema = spark.read.parquet(log).schema
    query = (
        spark.readStream.schema(schema)
        .parquet(log)
        .writeStream.foreachBatch(write_back)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def applied_batch(spark: SparkSession, root: str, checkpoint: str) -> int:
    """The number of the stream's batch that was written back last, -1 before any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/applied")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1
    done = spark.read.schema("stream string, batch bigint").json(f"{root}/applied").filter(F.col("stream") == checkpoint)
    return done.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def ingest_notes(
    spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int | None = None, opening: str | None = None
) -> DataFrame:
    """Bring newly arrived note files into a table of extracted notes, one row per note.

    A file is taken once, whole, when it arrives, also a late one; a task holds one at a time, so the folder's
    files should grow in number rather than in length. It is one note, or, with `opening`, as
    many as have that line, at which they are cut apart. Notes without a claim number
    stay in the table with their text in `_malformed`; `noted` and `malformed_notes` tell the two apart.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = reader.load(folder).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    if opening:
        each = F.explode(F.split("text", rf"(?m)^(?=\Q{opening}\E\r?$)"))
        arrived = arrived.select("file_name", each.alias("text")).filter("trim(text) <> ''")
    extracted = notes.extract_notes(arrived, keep_text=True)
    read = notes.dataset_notes(extracted, extra=["text"])
    read = read.withColumn(MALFORMED, F.when(F.col("claim_id").isNull(), F.col("text"))).drop("text")
    _run_to_end(read, out, checkpoint)
    return spark.read.schema(read.schema).parquet(out)


def noted(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def malformed_notes(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col(MALFORMED).isNotNull()).select("file_name", MALFORMED)


def current_claims(claims: DataFrame, log: DataFrame) -> DataFrame:
    """Claims with the newest logged decision applied, without a write; `compact_decisions` writes it."""
    return decisions.apply_decisions(claims, good_decisions(log))


def stream_status_counts(claims: DataFrame, log: DataFrame) -> DataFrame:
    """Claims per status as of the log; three columns of the claims are read, no more."""
    return kpis.count_by(current_claims(claims.select("claim_id", "status", "ai_decision", "ai_reasoning"), log), "status")
