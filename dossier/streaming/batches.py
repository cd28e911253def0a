"""Batch processing as streams: admission, progress, status and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 3) -> DataFrame:
    """Events from files, a bounded number per micro-batch; times without zone become timestamps, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; streams drop what is later than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def batch_status(events: DataFrame) -> DataFrame:
    """Status of each batch: that of its last event (batch_id, at, status), so a stream and a batch run agree."""
    return events.groupBy("batch_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def repair_interrupted(batches: DataFrame) -> DataFrame:
    """After a crash: whatever was waiting or running is interrupted."""
    return batches.withColumn("status", F.when(F.col("status").isin("queued", "processing"), "interrupted").otherwise(F.col("status")))


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Percent done per batch: up to 95 while files remain, then 100. done: (batch_id, file), totals: (batch_id, files)."""
    n = done.groupBy("batch_id").agg(F.count_distinct("file").alias("done"))
    return totals.join(n, "batch_id", "left").select("batch_id", F.when(F.coalesce("done", F.lit(0)) >= F.col("files"), 100).otherwise(F.floor(F.coalesce("done", F.lit(0)) * 95 / F.col("files"))).cast("int").alias("progress"))


def admit(requests: DataFrame, most_waiting: int = 3) -> DataFrame:
    """Adds admitted: the first requests (ord) while no more than `most_waiting` wait."""
    from pyspark.sql import Window

    return requests.withColumn("admitted", F.row_number().over(Window.partitionBy("queue").orderBy("ord")) <= most_waiting)


def upsert_sink(path: str):
    """A foreachBatch function that keeps versions of rows in a Parquet table: each micro-batch has a folder of its own, so a batch
    that is run again replaces itself.  latest_rows reads the latest version of each key."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The row of each key in the last micro-batch that holds the key."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c != "epoch"]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*names), "epoch").alias("row"))
    return latest.select("row.*")


def run_available(stream: DataFrame, path: str, key: list[str], checkpoint: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there into a table of versions under `path`, and return the latest row of each key.

    Nothing passes through the driver; a run that was interrupted goes on from its checkpoint.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(upsert_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_rows(stream.sparkSession, path, key)


def event_counts_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events table by a stream over its file, run until all is read."""
    import tempfile
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = event_stream(spark, f"{sf_dir}/events.parquet*", schema)
    counts = windowed_counts(events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
    # The shared folder of the session; one of its own only where none is named, as in tests.
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="dossier-")
    run = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:8]}"
    return run_available(counts, f"{run}/rows", ["start", "event_type"], f"{run}/checkpoint")
