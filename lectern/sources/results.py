"""A store of scored submissions: one record for each study, day of receipt and session.

The store is a Parquet table in folders of study_id and received_date. Each write adds files of its own (a folder `batch=n` below them), so nothing that is
stored is read or moved when a record arrives; a write that is repeated replaces its own files only. A record that is written again takes
the place of the former one when the store is read: of the records of a key the one that arrived last counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx

KEY = ["study_id", "received_date", "session_id"]
DETAILS = "array<struct<question_id:string,selected_index:int,correct:boolean>>"
SCHEMA = f"study_id string, received_date string, session_id string, result_key string, participant_id string, question_set_id string, received_at timestamp, arrival long, correct int, total int, details {DETAILS}, batch long"
REJECTED = "study_id string, participant_id string, session_id string, question_set_id string, received_at timestamp, arrival long, error string, batch long"


def records(scored: DataFrame) -> DataFrame:
    """Scored submissions with sanitised ids, the day of receipt (UTC) and the key of their record."""
    study, session, day = tx.path_segment(F.col("study_id")), tx.path_segment(F.col("session_id")), F.date_format("received_at", "yyyy-MM-dd")
    key = F.concat_ws("/", F.lit("study-results"), study, day, F.concat(session, F.lit(".json")))
    return scored.withColumn("result_key", key).withColumn("received_date", day).withColumn("study_id", study).withColumn("session_id", session)


def last_of_key(rows: DataFrame) -> DataFrame:
    """Of each key the record that arrived last."""
    others = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*others), "arrival").alias("r")).select(*KEY, "r.*")


def _append(rows: DataFrame, schema: str, folder: str, batch: int, by: list[str]) -> None:
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = rows.withColumn("batch", F.lit(batch).cast("bigint")).select(*names)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(folder)


def store(scored: DataFrame, folder: str, batch: int) -> None:
    """Writes the records of a batch; the same batch again changes nothing."""
    _append(last_of_key(records(scored)), SCHEMA, folder, batch, ["study_id", "received_date"])


def quarantine(rejected: DataFrame, folder: str, batch: int) -> None:
    """Writes submissions that are not stored, with their error."""
    _append(rejected, REJECTED, folder, batch, [])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored records, one for each key."""
    return last_of_key(spark.read.schema(SCHEMA).parquet(folder)).drop("batch")


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REJECTED).parquet(folder).drop("batch")
