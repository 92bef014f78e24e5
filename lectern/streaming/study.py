"""Structured Streaming forms of scoring, progress of jobs, and notices; each batch runs the same functions as the batch queries.

Scoring keeps no state: a batch's records are written under its number, and reading the store tells which record of a key counts. Progress keeps
the last state of a job for a period of event time, after which the watermark ends it. All sinks write a batch that is replayed in the same
place again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import features, study
from lectern.sources import results

JOB = ["document_id", "block_no", "kind"]
PROGRESS = "document_id long, block_no int, kind string, pos long, status string, done struct<pos:long,value:string>, bucket int, batch long"
#: Folders that documents of the progress table are dealt to; a batch reads only those of its own documents.
BUCKETS = 64


def read_files(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream over Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def arrive(batch: DataFrame, number: int, keys: DataFrame, out: str) -> None:
    """One batch of submissions: those that lack something, or whose key is unknown, go to quarantine, the others are scored and stored."""
    valid, invalid = study.split_valid(batch.withColumn("question_set_id", F.col("assignment.question_set_id")))
    scored = study.score_submissions(valid, keys).persist()
    results.store(scored.where("error IS NULL"), f"{out}/results", number)
    results.quarantine(invalid.unionByName(scored.where("error IS NOT NULL"), allowMissingColumns=True), f"{out}/rejected", number)
    scored.unpersist()


def score_submissions(submissions: DataFrame, keys: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Checks, scores and stores submissions as they arrive: columns of study.submission_error, received_at (a timestamp) and arrival (a number that grows).

    keys is a table that each batch reads anew (see study.folded_keys). Results are read by results.read, the rest by results.read_rejected.
    """
    return submissions.writeStream.foreachBatch(lambda batch, number: arrive(batch, number, keys, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each job and the last value it was done with, merged over all batches."""
    rows = spark.read.schema(PROGRESS).parquet(out)
    return rows.groupBy(*JOB).agg(F.max("pos").alias("pos"), F.max_by("status", "pos").alias("status"), F.max("done").alias("done"))


def apply_changes(batch: DataFrame, number: int, out: str) -> None:
    """Adds the jobs of a batch that differ from what earlier batches left; only the folders of the batch's documents are read."""
    new = batch.groupBy(*JOB).agg(F.max("pos").alias("pos"), F.max_by("status", "pos").alias("status"), F.max("done").alias("done"))
    new = new.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")).persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    old = batch.sparkSession.read.schema(PROGRESS).parquet(out).where(F.col("bucket").isin(touched) & (F.col("batch") < number))
    old = old.groupBy(*JOB).agg(F.max("pos").alias("__pos"), F.max_by("status", "pos").alias("__status"), F.max("done").alias("__done"))
    joined = new.join(old.hint("merge"), JOB, "left")
    later = F.coalesce(F.col("pos") > F.col("__pos"), F.lit(True)) & ~F.col("status").eqNullSafe(F.col("__status"))
    better = F.col("done").isNotNull() & (F.col("__done").isNull() | (F.col("done") > F.col("__done")))
    changed = joined.where(later | better).select(*new.columns).withColumn("batch", F.lit(number).cast("bigint"))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)
    new.unpersist()


def progress(events: DataFrame, out: str, checkpoint: str, late: str = "1 day", period: str = "30 days") -> StreamingQuery:
    """Merges job events into a table of each job's last state and last value as they arrive, and writes changes only.

    events: document_id, block_no, kind, status, value (of completed jobs), pos (grows with each event) and updated_at. State is kept for a job and
    period; it ends when the watermark, `late` behind the last event, has passed the period. Events that are later than that are dropped.
    """
    spark = events.sparkSession
    spark.createDataFrame([], PROGRESS).write.mode("append").partitionBy("bucket", "batch").parquet(out)
    done = F.when((F.col("status") == "complete") & F.col("value").isNotNull(), F.struct("pos", "value"))
    dated = events.withWatermark("updated_at", late).withColumn("done", done).groupBy(F.window("updated_at", period), *JOB)
    state = dated.agg(F.max("pos").alias("pos"), F.max_by("status", "pos").alias("status"), F.max("done").alias("done"))
    store = lambda batch, number: apply_changes(batch.drop("window"), number, out)
    return state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notices(events: DataFrame, out: str, checkpoint: str, late: str = "60 days") -> StreamingQuery:
    """Each failure signature once."""
    failed = events.where("status = 'failed'").withColumn("signature", features.failure_signature())
    once = failed.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["signature"]).select("signature", "updated_at")
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
