"""Streams over the events table, run to the end of what is there, and sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import features, study
from lectern.operators.settings import fixed_rows
from lectern.plans import views
from lectern.plans.registry import query
from lectern.plans.study_queries import SCORED
from lectern.plans.text_queries import block_rows, events
from lectern.session import prepare, shared_dir
from lectern.sources import results
from lectern.streaming.study import progress, read_files, read_progress, score_submissions


def event_stream(spark, sf_dir):
    schema = events(spark, sf_dir).schema
    return read_files(spark, f"{sf_dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def scratch(spark, name):
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def arrivals(spark, sf_dir):
    """A submission for each session, sent when its last event is there; every seventh participant's was sent before, with first choices
    only. Participants whose number leaves 3 to 8 when divided by 11 leave something out, or name a key that is not there."""
    given = views.submissions(spark, sf_dir).groupBy("session_id", "participant_id").agg(F.array_sort(F.collect_list(F.struct("pos", "question_id", "selected_index"))).alias("a"), F.max("submitted_at").alias("received_at"), F.max("pos").alias("arrival"))
    n = F.col("participant_id") % 11
    answers = F.transform("a", lambda x: F.struct(x["question_id"].alias("question_id"), x["selected_index"].alias("selected_index")))
    whole = given.select(
        F.when(n == 4, "").otherwise(F.concat(F.lit("study "), (F.col("participant_id") % 3).cast("string"))).alias("study_id"),
        F.when(n != 3, F.col("participant_id").cast("string")).alias("participant_id"),
        F.when(n != 8, F.col("session_id")).alias("session_id"),
        F.struct(F.when(n == 7, "none").when(n != 5, "set").alias("question_set_id")).alias("assignment"),
        F.when(n != 6, answers).alias("answers"),
        "received_at",
        (F.col("arrival") * 2 + 1).alias("arrival"),
        (F.col("participant_id") % 7 == 0).alias("twice"),
    )
    before = whole.where("twice").withColumn("arrival", F.col("arrival") - 1)
    first = F.transform("answers", lambda x: F.struct(x["question_id"].alias("question_id"), F.lit(0).alias("selected_index")))
    return whole.unionByName(before.withColumn("answers", first)).drop("twice")


def stored_keys(spark):
    """The key of the set, in which the second question stood with another answer before and the third stands again later."""
    rows = [("set", "q1", 0, 1), ("set", "q2", 1, 0), ("set", "q3", 2, 0), ("set", "q2", 3, 2), ("set", "q3", 4, 3), ("other", "q1", 0, 4)]
    return spark.createDataFrame(rows, "question_set_id string, question_id string, ordinal int, answer_index int")


ARRIVED = f"""{SCORED}, ss AS (SELECT session_id, participant_id AS p, max(submitted_at) AS received_at, max(pos) * 2 + 1 AS arrival FROM submissions GROUP BY 1, 2),
 er AS (SELECT *, CASE p % 11 WHEN 3 THEN 'Missing participant_id.' WHEN 4 THEN 'Missing study_id.' WHEN 5 THEN 'Missing question_set_id.' WHEN 6 THEN 'Missing answers.' WHEN 7 THEN 'Answer key not found.' WHEN 8 THEN 'Missing session_id.' END AS error FROM ss),
 kept AS (SELECT 'study-' || (p % 3) AS study_id, strftime(received_at, '%Y-%m-%d') AS received_date, session_id, arrival, correct, total, details FROM er JOIN scored USING (session_id) WHERE error IS NULL),
 sent AS (SELECT * FROM er UNION ALL SELECT session_id, p, received_at, arrival - 1, error FROM er WHERE p % 7 = 0)"""


def shown():
    """Details as text."""
    return F.array_join(F.transform("details", lambda d: F.concat(d["question_id"], F.lit("="), F.coalesce(d["selected_index"].cast("string"), F.lit("null")), F.when(d["correct"], "+").otherwise("-"))), ",")


def submitted(spark, sf_dir):
    """The folder in which the stream over the landed submissions has stored its results."""
    landed, out = scratch(spark, "landed"), scratch(spark, "study")
    rows = arrivals(spark, sf_dir)
    rows.repartitionByRange(3, "arrival").write.parquet(landed)
    score_submissions(read_files(spark, landed, rows.schema, files_per_trigger=1), stored_keys(spark), out, scratch(spark, "cp")).awaitTermination()
    return out


@query(
    "k1_scored_stream",
    f"""WITH {ARRIVED} SELECT study_id, received_date, session_id, arrival, correct, total, details, NULL AS error FROM kept
    UNION ALL SELECT CASE WHEN p % 11 = 4 THEN '' ELSE 'study ' || (p % 3) END, NULL, CASE WHEN p % 11 <> 8 THEN session_id END, arrival, NULL, NULL, NULL, error FROM sent WHERE error IS NOT NULL""",
)
def k1(spark, sf_dir):
    """Submissions checked, scored and stored as they arrive, read back with those in quarantine."""
    out = submitted(prepare(spark), sf_dir)
    kept = results.read(spark, f"{out}/results").select("study_id", "received_date", "session_id", "arrival", "correct", "total", shown().alias("details"))
    rejected = results.read_rejected(spark, f"{out}/rejected").select("study_id", "session_id", "arrival", "error")
    return kept.unionByName(rejected, allowMissingColumns=True)


@query("a14_result_keys", f"WITH {ARRIVED} SELECT study_id, received_date, session_id, 'study-results/' || study_id || '/' || received_date || '/' || session_id || '.json' AS result_key, correct FROM kept")
def a14(spark, sf_dir):
    """Two writes of the same records, the second with other scores, read back once each."""
    folder = scratch(spark, "results")
    valid, _ = study.split_valid(arrivals(prepare(spark), sf_dir))
    scored = study.score_submissions(valid, stored_keys(spark)).where("error IS NULL")
    results.store(scored.withColumn("correct", F.lit(-1)).withColumn("arrival", F.col("arrival") - 2), folder, 0)
    results.store(scored, folder, 1)
    return results.read(spark, folder).select("study_id", "received_date", "session_id", "result_key", "correct")


PROGRESSED = f"""{views.JOBS}, done AS (SELECT document_id, block_no, kind, max(pos) AS dpos FROM jobs WHERE status = 'complete' GROUP BY ALL), bs AS (SELECT DISTINCT document_id, block_no, 'keywords' AS kind, 'old' AS value FROM jobs)"""


@query(
    "k2_job_state_stream",
    f"""WITH {PROGRESSED}, ks AS (SELECT document_id, block_no, kind FROM state UNION SELECT document_id, block_no, kind FROM bs)
    SELECT document_id, block_no, kind, status, coalesce('v' || dpos, value) AS value, dpos IS NOT NULL AS changed FROM ks LEFT JOIN state USING (document_id, block_no, kind) LEFT JOIN done USING (document_id, block_no, kind) LEFT JOIN bs USING (document_id, block_no, kind) WHERE dpos IS NOT NULL OR value IS NOT NULL""",
)
def k2(spark, sf_dir):
    """Values of completed jobs merged into the blocks' old ones while events arrive, with the jobs' last states."""
    out, keys = scratch(prepare(spark), "progress"), ["document_id", "block_no"]
    progress(views.job_events(event_stream(spark, sf_dir)), out, scratch(spark, "cp")).awaitTermination()
    last = read_progress(spark, out)
    old = views.jobs(spark, sf_dir).select(*keys).distinct().select(*keys, F.lit("keywords").alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("old").alias("value"))
    new = last.where("done IS NOT NULL").select(*keys, "kind", "done.pos", "done.value")
    merged = features.merge_by_kind(old, new, keys).drop("pos")
    return merged.join(last.select(*keys, "kind", "status").hint("merge"), [*keys, "kind"], "left")


@query("c5_eligibility", f"WITH {views.BLOCKS}, n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]*')) AS words FROM blocks) SELECT document_id, block_no, words > 20 AS keywords, words > 35 AS summary FROM n")
def c5(spark, sf_dir):
    words = tx.word_count(F.col("text"))
    least = {r["kind"]: max(r["least_words"], 20) for r in fixed_rows(features.definitions(spark))}
    return block_rows(spark, sf_dir).select("document_id", "block_no", *((words > n).alias(kind) for kind, n in least.items()))
