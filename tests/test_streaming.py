"""Streams give what the batch queries give on the same files."""

from conftest import SMALL
from pyspark.sql import functions as F

from lectern.operators import features, study
from lectern.plans import views
from lectern.plans.stream_queries import arrivals, stored_keys
from lectern.sources import results
from lectern.streaming import study as streams


def snapshot(frame):
    return sorted(map(str, frame.collect()))


def test_submissions_are_stored_once(spark, tmp_path):
    out, rows, keys = str(tmp_path), arrivals(spark, SMALL), stored_keys(spark)
    parts = [rows.where(F.col("arrival") % 3 == k) for k in range(3)]
    for k, part in enumerate(parts):
        streams.arrive(part, k, keys, out)
    kept, rejected = snapshot(results.read(spark, f"{out}/results")), snapshot(results.read_rejected(spark, f"{out}/rejected"))
    assert len(kept) + len(set(rejected)) > 300 and any("Answer key not found." in r for r in rejected)
    for k in (2, 0):  # batches replayed
        streams.arrive(parts[k], k, keys, out)
    assert snapshot(results.read(spark, f"{out}/results")) == kept and snapshot(results.read_rejected(spark, f"{out}/rejected")) == rejected
    # a record sent again takes the other's place
    again = rows.where("answers IS NOT NULL").withColumn("arrival", F.col("arrival") + 10**9).withColumn("answers", F.array().cast(rows.schema["answers"].dataType))
    streams.arrive(again, 3, keys, out)
    later = results.read(spark, f"{out}/results")
    assert later.count() == len(kept) and later.where("arrival > 1000000000").agg(F.sum("correct")).first()[0] == 0


def test_score_of_a_submission(spark):
    answers = "array<struct<question_id:string,selected_index:int>>"
    rows = [("s", "p", "x", ("set",), [("q1", 0), ("q9", 2), ("q1", 1), ("q2", -1)], 1), ("s", "p", "y", ("none",), [], 2), ("s", "p", "z", ("set",), [], 3)]
    docs = spark.createDataFrame(rows, f"study_id string, participant_id string, session_id string, assignment struct<question_set_id:string>, answers {answers}, arrival long")
    found = {r["session_id"]: r for r in study.score_submissions(docs, stored_keys(spark)).collect()}
    assert [tuple(d) for d in found["x"]["details"]] == [("q1", 1, True), ("q2", None, False), ("q3", None, False)]
    assert (found["x"]["correct"], found["x"]["total"], found["z"]["correct"], found["y"]["error"]) == (1, 3, 0, "Answer key not found.")


def test_progress_stream_equals_batch(spark, tmp_path):
    events = views.jobs(spark, SMALL)
    events.repartitionByRange(3, "pos").write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    streams.progress(stream, out, str(tmp_path / "cp"), late="60 days").awaitTermination(120)
    last = streams.read_progress(spark, out)
    assert snapshot(last.select(*streams.JOB, "status")) == snapshot(features.latest(events, streams.JOB, "pos", "status").select(*streams.JOB, "status"))
    done = events.where("status = 'complete'").groupBy(*streams.JOB).agg(F.max(F.struct("pos", "value")).alias("done"))
    assert snapshot(last.where("done IS NOT NULL").select(*streams.JOB, "done")) == snapshot(done)
    written = spark.read.schema(streams.PROGRESS).parquet(out)
    assert written.select("batch").distinct().count() >= 3
    # a batch that tells nothing new, and one that is replayed, write nothing new
    before = written.count()
    batch = last.withColumn("window", F.lit(1)).drop("window")
    streams.apply_changes(batch, 100, out)
    assert spark.read.schema(streams.PROGRESS).parquet(out).count() == before


def test_progress_state_ends(spark, tmp_path):
    """A period that the watermark has passed leaves the state; what comes later than that is dropped."""
    rows = [(0, 1, "pending"), (5, 2, "complete"), (40, 3, "pending"), (80, 4, "pending"), (1, 5, "failed")]
    schema = "document_id long, block_no int, kind string, status string, pos long, updated_at timestamp, value string"
    for day, pos, status in rows:
        frame = spark.createDataFrame([(1 if pos in (1, 2, 5) else pos, 0, "keywords", status, pos)], "document_id long, block_no int, kind string, status string, pos long")
        frame.select("*", F.timestamp_seconds(F.lit(1_700_000_000 + day * 86_400)).alias("updated_at"), F.lit("v").alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.progress(streams.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
    last = {r["document_id"]: r["status"] for r in streams.read_progress(spark, str(tmp_path / "out")).collect()}
    assert last == {1: "complete", 3: "pending", 4: "pending"} and kept <= 2


def test_each_failure_is_told_once(spark, tmp_path):
    events = views.jobs(spark, SMALL)
    events.repartitionByRange(3, "pos").write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    streams.notices(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = [r["signature"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    failed = events.where("status = 'failed'").select("document_id", "kind").distinct()
    assert len(got) == len(set(got)) == failed.count()


def test_deadline_closes_what_is_not_handed_in(spark, tmp_path):
    from lectern.streaming.deadline import close_sessions

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, at timestamp, kind string"
    rows = [("a", 0, "answer"), ("a", 5, "submit"), ("b", 0, "answer"), ("b", 20, "answer"), ("b", 90, "answer"), ("z", 0, "answer")]
    for n, part in enumerate((rows, [("z", 3600, "submit")])):
        frame = spark.createDataFrame([(s, k, kind) for s, k, kind in part], "session_id string, sec long, kind string")
        frame.select("session_id", F.timestamp_seconds(F.col("sec") + 1_700_000_000).alias("at"), "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        query = close_sessions(stream, 60_000, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r["session_id"], r["answers"], r["closed_by"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("a", 1, "participant"), ("b", 2, "deadline")} <= got
