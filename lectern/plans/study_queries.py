"""Queries of assignment, scoring, timing and the streams' batch twins (inventory H, I, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import features, study
from lectern.plans import views
from lectern.plans.registry import query
from lectern.plans.text_queries import events

DRAW = "CAST(('0x' || substr(md5('study:' || user_id), 1, 8)) AS BIGINT) / 4294967296.0"


def scheduler(spark, sf_dir):
    """An item for each participant there is, so that the scheduler grows with them: every fifth without weight, some negative, every 13th of an exam that is gone."""
    n = F.col("user_id")
    weight = F.when(n % 17 == 3, -1.0).otherwise((n % 5).cast("double"))
    return participants(spark, sf_dir).select(F.concat(F.when(n % 13 == 1, "gone").otherwise("ex"), n.cast("string")).alias("exam_id"), weight.alias("weight"), n.alias("ordinal"))


def manifest(spark, sf_dir):
    """The exams that there are."""
    n = F.col("user_id")
    return participants(spark, sf_dir).select(F.concat(F.lit("ex"), n.cast("string")).alias("exam_id"), n.alias("ordinal"), (n % 50).alias("document_id"))


def participants(spark, sf_dir):
    return events(spark, sf_dir).select("user_id").distinct().withColumn("study", F.lit("study"))


EXAM_SQL = "pt AS (SELECT DISTINCT user_id FROM events), ex AS (SELECT 'ex' || user_id AS exam_id, user_id AS ordinal, CAST(user_id % 5 AS DOUBLE) AS weight FROM pt WHERE user_id % 5 > 0 AND user_id % 17 <> 3 AND user_id % 13 <> 1)"
ASSIGNED = f"""{EXAM_SQL}, us AS (SELECT *, sum(weight) OVER (ORDER BY ordinal) AS hi, sum(weight) OVER () AS total FROM ex),
 dr AS (SELECT user_id, {DRAW} AS u FROM pt),
 assigned AS (SELECT user_id, exam_id FROM dr JOIN us ON u * total <= hi AND (u * total > hi - weight OR (hi = weight AND u = 0)))"""


@query("h1_weighted_assignment", f"WITH {ASSIGNED} SELECT * FROM assigned")
def h1(spark, sf_dir):
    return assigned(spark, sf_dir)


def assigned(spark, sf_dir):
    return study.weighted_assignment(participants(spark, sf_dir), scheduler(spark, sf_dir), ["study", "user_id"], manifest(spark, sf_dir)).select("user_id", "exam_id")


@query("h2_uniform_assignment", f"WITH {EXAM_SQL}, ev AS (SELECT user_id AS exam, row_number() OVER (ORDER BY user_id) - 1 AS k, count(*) OVER () AS n FROM pt), dr AS (SELECT user_id, {DRAW} AS u FROM pt) SELECT user_id, 'ex' || exam AS exam_id FROM dr JOIN ev ON floor(u * n) = k")
def h2(spark, sf_dir):
    """A scheduler without any usable weight."""
    even = scheduler(spark, sf_dir).withColumn("weight", F.lit(0.0))
    return study.weighted_assignment(participants(spark, sf_dir), even, ["study", "user_id"], manifest(spark, sf_dir)).select("user_id", "exam_id")


@query(
    "h3_sticky",
    f"""WITH {ASSIGNED}, st AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'ex' || user_id ELSE 'old' || user_id END AS exam_id, user_id % 4 <> 0 AS same_study, user_id % 7 <> 0 AS there FROM pt WHERE user_id % 3 <> 0)
    SELECT a.user_id, CASE WHEN v THEN st.exam_id ELSE a.exam_id END AS exam_id, v AS reused FROM (SELECT a.*, coalesce(st.exam_id LIKE 'ex%' AND same_study AND there, false) AS v FROM assigned a LEFT JOIN st USING (user_id)) a LEFT JOIN st USING (user_id)""",
)
def h3(spark, sf_dir):
    """Stored assignments of this study and of others, of exams and of documents that are gone, and none for every third participant."""
    n = F.col("user_id")
    stored = participants(spark, sf_dir).where("user_id % 3 <> 0").select(
        "user_id",
        F.when(n % 4 == 0, "other").otherwise("study").alias("study_id"),
        F.concat(F.when(n % 2 == 0, "ex").otherwise("old"), n.cast("string")).alias("exam_id"),
        F.when(n % 7 == 0, F.lit(-1).cast("long")).otherwise(n % 50).alias("document_id"),
    )
    exams = manifest(spark, sf_dir)
    return study.sticky(stored, assigned(spark, sf_dir), exams, exams, "user_id", "study").select("user_id", "exam_id", "reused")


@query("h5_kind_draw", f"WITH pt AS (SELECT DISTINCT user_id FROM events) SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'summary' WHEN {DRAW} < 0.5 THEN 'keywords' ELSE 'summary' END AS kind FROM pt")
def h5(spark, sf_dir):
    rows = participants(spark, sf_dir)
    chosen = F.when(F.col("user_id") % 3 == 0, "summary").when(F.col("user_id") % 3 == 1, "either")
    return rows.select("user_id", study.assigned_kind(["study", "user_id"], chosen).alias("kind"))


SCORED = f"""{views.SUBMISSIONS}, la AS (SELECT session_id, question_id, arg_max(coalesce(selected_index, -1), pos) AS c FROM submissions GROUP BY 1, 2), se AS (SELECT DISTINCT session_id FROM submissions),
 sheet AS (SELECT se.session_id, k.question_id, k.ordinal, k.answer_index, nullif(la.c, -1) AS selected_index FROM se CROSS JOIN answer_key k LEFT JOIN la USING (session_id, question_id)),
 scored AS (SELECT session_id, CAST(count(*) FILTER (selected_index = answer_index) AS INT) AS correct, CAST(count(*) AS INT) AS total, string_agg(question_id || '=' || coalesce(CAST(selected_index AS VARCHAR), 'null') || CASE WHEN selected_index = answer_index THEN '+' ELSE '-' END, ',' ORDER BY ordinal) AS details FROM sheet GROUP BY 1)"""


@query("i2_scoring", f"WITH {SCORED} SELECT * FROM scored")
def i2(spark, sf_dir):
    return study.score(views.submissions(spark, sf_dir), views.answer_key(spark))


@query("i4_answer_sheet", f"WITH {SCORED} SELECT session_id, question_id, ordinal, answer_index, selected_index FROM sheet")
def i4(spark, sf_dir):
    return study.answer_sheet(views.submissions(spark, sf_dir), views.answer_key(spark))


@query("i5_timing", f"WITH {views.SUBMISSIONS}, sp AS (SELECT session_id, CAST(floor(epoch_us(max(submitted_at)) / 1e6 - epoch_us(min(submitted_at)) / 1e6) AS BIGINT) AS elapsed, CAST(floor(epoch_us(max(submitted_at)) / 1e6 - epoch_us(min(submitted_at)) / 1e6 + 0.5) AS BIGINT) AS total_elapsed FROM submissions GROUP BY 1) SELECT session_id, elapsed, total_elapsed, greatest(900 - elapsed, 0) AS remaining, elapsed >= 900 AS expired FROM sp")
def i5(spark, sf_dir):
    return study.timing(views.submissions(spark, sf_dir), F.lit(900))


@query("i4_accepted", f"WITH {SCORED}, sp AS (SELECT session_id, floor(epoch_us(max(submitted_at)) / 1e6 - epoch_us(min(submitted_at)) / 1e6) >= 900 AS late FROM submissions GROUP BY 1) SELECT s.session_id, s.complete, s.complete OR late AS accepted FROM (SELECT session_id, count(selected_index) = 3 AS complete FROM sheet GROUP BY 1) s JOIN sp USING (session_id)")
def i4_accepted(spark, sf_dir):
    """Sheets that are complete, and incomplete ones that time has closed."""
    answers, key = views.submissions(spark, sf_dir), views.answer_key(spark)
    late = study.timing(answers, F.lit(900)).select(F.col("session_id").alias("__session"), "expired")
    sheet = study.answer_sheet(answers, key)
    complete = study.answered(sheet, F.lit(False)).drop("accepted")
    joined = complete.join(late.hint("merge"), F.col("session_id") == F.col("__session"))
    return joined.select("session_id", "complete", (F.col("complete") | F.col("expired")).alias("accepted"))


@query("i3_positional_score", f"WITH {SCORED} SELECT session_id, CAST(count(*) FILTER (selected_index = answer_index) AS INT) AS n FROM sheet GROUP BY 1")
def i3(spark, sf_dir):
    sheet = study.answer_sheet(views.submissions(spark, sf_dir), views.answer_key(spark)).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "selected_index", "answer_index"))).alias("s"))
    return sheet.select("session_id", study.positional_score(F.transform("s", lambda x: x["selected_index"]), F.transform("s", lambda x: x["answer_index"])).alias("n"))


@query("i7_scales", "SELECT event_id, array_to_string(range(1, CAST(3 + event_id % 5 AS INT) + 1), ',') AS points FROM events")
def i7(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(study.scale(F.lit(1), (F.col("event_id") % 5 + 3).cast("int")).cast("array<string>"), ",").alias("points"))


@query("i8_upsert", "WITH u AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS value FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT event_id + 10000000, 'changed' FROM events WHERE event_id % 5 = 0) SELECT id, value, row_number() OVER (ORDER BY id) AS place FROM u")
def i8(spark, sf_dir):
    """Changed and new rows, then every third row deleted, in order."""
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("value"))
    changed = rows.where("id % 5 = 0").withColumn("value", F.lit("changed"))
    merged = study.upsert(rows, changed.unionByName(changed.withColumn("id", F.col("id") + 10_000_000)), "id")
    return study.in_order(study.delete(merged, rows.where("id % 3 = 1"), "id"), "id")


@query("c9_questionnaire", f"WITH {SCORED} SELECT session_id, count(selected_index) = 3 AS complete FROM sheet GROUP BY 1")
def c9(spark, sf_dir):
    sheet = study.answer_sheet(views.submissions(spark, sf_dir), views.answer_key(spark))
    return sheet.groupBy("session_id").agg(F.bool_and(F.col("selected_index").isNotNull()).alias("complete"))


@query("k3_deadline", f"WITH {views.SUBMISSIONS}, sp AS (SELECT session_id, min(submitted_at) AS began FROM submissions GROUP BY 1) SELECT s.session_id, count(*) FILTER (submitted_at <= began + INTERVAL 6 HOUR) AS answers_in_time, count(*) FILTER (submitted_at > began + INTERVAL 6 HOUR) AS late FROM submissions s JOIN sp USING (session_id) GROUP BY 1")
def k3(spark, sf_dir):
    return study.in_time(views.submissions(spark, sf_dir), F.expr("INTERVAL 6 HOURS"))


@query("k4_notices", f"WITH {views.JOBS} SELECT sha256(document_id || ':' || kind) AS signature, min(pos) AS first_pos FROM jobs WHERE status = 'failed' GROUP BY 1")
def k4(spark, sf_dir):
    return features.first_failures(views.jobs(spark, sf_dir))
