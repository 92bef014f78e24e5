"""Assignment of participants, exams, scoring, timing and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as tx
from lectern.operators.settings import fixed_rows
from lectern.session import materialize

# Choices of a question that has none.
DEFAULT_CHOICES = ("Choice 1", "Choice 2")


#: What a submission must have, in the order in which it is looked at.
SUBMISSION_FIELDS = ["study_id", "participant_id", "session_id", "assignment.question_set_id"]


def submission_error() -> Column:
    """The message for the first thing that a submission lacks, null if it has all. Columns: study_id, participant_id, session_id,
    assignment (a struct with question_set_id) and answers (an array, which may be empty)."""
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"Missing {c.rsplit('.', 1)[-1]}.")) for c in SUBMISSION_FIELDS]
    return F.coalesce(*missing, F.when(F.col("answers").isNull(), "Missing answers."))


def split_valid(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions that have all they must, and the others with their error."""
    checked = submissions.withColumn("error", submission_error())
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def folded_keys(keys: DataFrame) -> DataFrame:
    """question_set_id and its questions (ordinal, question_id, answer_index) in order. keys: question_set_id, question_id, ordinal, answer_index;
    a question that stands there again keeps its first place and takes the last answer."""
    once = keys.groupBy("question_set_id", "question_id").agg(F.min("ordinal").alias("ordinal"), F.max_by(F.struct("answer_index"), "ordinal")["answer_index"].alias("answer_index"))
    return once.groupBy("question_set_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "question_id", "answer_index"))).alias("questions"))


def score_submissions(submissions: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole submissions with correct, total and details over the questions of their key, and an error if there is no such key.

    The answers (array of question_id, selected_index) stand in their order; the last one to a question counts, a negative choice is none, and
    answers to other questions are ignored. Keys may be a table of any size; they are joined by their question_set_id.
    """
    joined = submissions.withColumn("question_set_id", F.col("assignment.question_set_id")).join(folded_keys(keys), "question_set_id", "left")

    def mark(q: Column) -> Column:
        choice = F.try_element_at(F.filter("answers", lambda a: a["question_id"] == q["question_id"]), F.lit(-1))["selected_index"]
        return F.struct(q["question_id"].alias("question_id"), F.when(choice >= 0, choice).cast("int").alias("selected_index"), F.coalesce(choice == q["answer_index"], F.lit(False)).alias("correct"))

    marked = joined.withColumn("details", F.transform("questions", mark)).withColumn("total", F.size("details"))
    right = F.size(F.filter("details", lambda d: d["correct"])).cast("int")
    return marked.withColumn("correct", right).withColumn("error", F.when(F.col("questions").isNull(), "Answer key not found.")).drop("questions")


def draw(*keys: str) -> Column:
    """A reproducible number in [0, 1) of the keys (the first 32 bits of their MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Schedulers of more items are looked up by a join; buckets that draws are dealt to at least, so that a few exams don't make a few large tasks.
FEW_ITEMS, LEAST_BUCKETS = 64, 4096


def _bounds(manifest: DataFrame, items: DataFrame) -> tuple[DataFrame, bool]:
    """exam_id, lo, hi, first of the scheduler's usable items in order, and whether they are weighted; without any, every exam has one part of the whole."""
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    usable = items.join(manifest.select("exam_id").distinct().hint("merge"), "exam_id", "left_semi").withColumn("__w", F.when(F.isnan(weight), 0.0).otherwise(weight)).where("__w > 0")
    weighted = not usable.isEmpty()
    rows = usable if weighted else manifest.select("exam_id", "ordinal").withColumn("__w", F.lit(1.0))
    # one task sorts the items; a scheduler is small beside its participants
    order = Window.orderBy("ordinal", "exam_id")
    high = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hi", high).withColumn("lo", F.lag("hi", 1, 0.0).over(order))
    return rows.select("exam_id", "lo", "hi", (F.col("lo") == 0).alias("first")), weighted


def weighted_assignment(participants: DataFrame, items: DataFrame, key: list[str], manifest: DataFrame | None = None) -> DataFrame:
    """The participants with exam_id: the first item of the scheduler whose cumulative weight reaches the participant's draw.

    items (exam_id, weight, ordinal) is the scheduler, manifest (exam_id, ordinal) has the exams that there are (if left out, those of the
    scheduler). Negative weights are none, and items of exams that are not there are passed over; without a usable item all exams are as
    likely; no exam at all is an error. A few items are looked up in the row; more are dealt to buckets of equal parts of the whole that they
    overlap, so that each draw meets the items of its bucket only.
    """
    bounds, weighted = _bounds(items.select("exam_id", "ordinal") if manifest is None else manifest, items)
    bounds = materialize(bounds, "bounds")
    size = bounds.agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("total")).first()
    if not size["n"]:
        raise ValueError("there is no exam to assign")
    drawn = participants.withColumn("__x", draw(*key) * F.lit(size["total"]))
    # weights: the first whose end is reached; without weights whole parts of the range
    hit = lambda x, lo, hi, first: ((x > lo) & (x <= hi)) | (first & (x == 0)) if weighted else (x >= lo) & (x < hi)
    if size["n"] <= FEW_ITEMS:
        chosen = F.lit(None).cast("string")
        for r in bounds.collect():  # FEW_ITEMS at most
            chosen = F.when(hit(F.col("__x"), F.lit(r["lo"]), F.lit(r["hi"]), F.lit(r["first"])), F.lit(r["exam_id"])).otherwise(chosen)
        return drawn.select(*participants.columns, chosen.alias("exam_id"))
    count = max(size["n"], LEAST_BUCKETS)
    bucket = lambda v: F.least(F.floor(v / F.lit(size["total"]) * count), F.lit(count - 1))
    dealt = bounds.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    joined = drawn.withColumn("__bucket", bucket(F.col("__x"))).join(dealt.hint("merge"), "__bucket")
    return joined.where(hit(F.col("__x"), F.col("lo"), F.col("hi"), F.col("first"))).select(*participants.columns, "exam_id")


def sticky(stored: DataFrame, drawn: DataFrame, exams: DataFrame, documents: DataFrame, key: str, study_id: str) -> DataFrame:
    """The drawn assignments, and a stored one of the same study in their place while its exam and its document are still there.

    stored: key, study_id, exam_id, document_id; drawn: key, exam_id; exams: exam_id; documents: document_id.
    """
    valid = stored.where(F.col("study_id") == study_id).join(exams.select("exam_id").distinct().hint("merge"), "exam_id", "left_semi")
    valid = valid.join(documents.select("document_id").distinct().hint("merge"), "document_id", "left_semi").select(key, F.col("exam_id").alias("__kept"))
    joined = drawn.join(valid.hint("merge"), key, "left")
    return joined.withColumn("reused", F.col("__kept").isNotNull()).withColumn("exam_id", F.coalesce("__kept", "exam_id")).drop("__kept")


def assignment(exams: DataFrame) -> DataFrame:
    """What a participant is given of an exam: exam_id, condition_id (`default` if none), document_id, question_set_id, question_url (its usual place if none),
    visible (the kinds shown) and time_limit_seconds. exams: these columns, as they stand in a manifest."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return exams.select(
        "exam_id",
        F.coalesce(blank("condition_id"), F.lit("default")).alias("condition_id"),
        "document_id",
        "question_set_id",
        F.coalesce(blank("question_url"), question_url(F.col("question_set_id"))).alias("question_url"),
        F.coalesce("visible", F.array().cast("array<string>")).alias("visible"),
        F.coalesce("time_limit_seconds", F.lit(0)).alias("time_limit_seconds"),
    )


def question_url(question_set_id: Column) -> Column:
    """Where the public questions of a set are."""
    return F.concat(F.lit("/study-cache/questions/"), question_set_id, F.lit(".json"))


def assigned_kind(key: list[str], chosen: Column) -> Column:
    """The kind of representation that was chosen, if it is one of the two, else one of them by the draw."""
    return F.when(chosen.isin("keywords", "summary"), chosen).when(draw(*key) < 0.5, "keywords").otherwise("summary")


def last_answers(answers: DataFrame) -> DataFrame:
    """The last answer of each session to each question; a negative choice is none."""
    choice = F.when(F.col("selected_index") >= 0, F.col("selected_index"))
    return answers.groupBy("session_id", "question_id").agg(F.max_by(F.struct(choice.alias("c")), "pos")["c"].alias("selected_index"))


def score(answers: DataFrame, key: DataFrame) -> DataFrame:
    """correct, total and details of each session over all questions of the key, in the key's order.

    The key is a short fixed table; answers to other questions are ignored.
    """
    sheet = answer_sheet(answers, key)
    correct = F.coalesce(F.col("selected_index") == F.col("answer_index"), F.lit(False))
    marked = sheet.withColumn("correct", correct)
    return marked.groupBy("session_id").agg(
        F.count_if("correct").cast("int").alias("correct"),
        F.count(F.lit(1)).cast("int").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "question_id", F.coalesce(F.col("selected_index").cast("string"), F.lit("null")).alias("s"), "correct"))), lambda d: F.concat(d["question_id"], F.lit("="), d["s"], F.when(d["correct"], "+").otherwise("-"))), ",").alias("details"),
    )


def answer_sheet(answers: DataFrame, key: DataFrame) -> DataFrame:
    """One row for each session and question of the key, selected_index null when unanswered.

    The key (question_id, ordinal, answer_index) is a table of settings (see settings.fixed_rows); each session gets its questions in its
    row, and its answers are collected there, so nothing is joined. A question that the key has twice keeps its first place and takes the last answer.
    """
    rows: dict = {}
    for r in sorted(fixed_rows(key.select("question_id", "ordinal", "answer_index")), key=lambda r: r["ordinal"]):
        first = rows.get(r["question_id"], r)
        rows[r["question_id"]] = {**r.asDict(), "ordinal": first["ordinal"]}
    given = last_answers(answers).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", "selected_index"))).alias("__given"))
    kinds = {f.name: f.dataType for f in key.schema}
    questions = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in ("question_id", "ordinal", "answer_index")]) for r in rows.values()])
    sheet = given.select("session_id", "__given", F.explode(questions).alias("q")).select("session_id", "__given", "q.*")
    return sheet.select("session_id", "question_id", "ordinal", "answer_index", F.try_element_at("__given", F.col("question_id")).alias("selected_index"))


def answered(sheet: DataFrame, timed_out: Column) -> DataFrame:
    """session_id, complete (every question has an answer) and accepted: an incomplete sheet is handed in only when time has run out. sheet: answer_sheet()."""
    rows = sheet.groupBy("session_id").agg(F.bool_and(F.col("selected_index").isNotNull()).alias("complete"))
    return rows.withColumn("accepted", F.col("complete") | timed_out)


def positional_score(selected: Column, answers: Column) -> Column:
    """How many of two arrays' entries at one place are equal."""
    return F.size(F.filter(F.zip_with(selected, answers, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same))


def in_time(answers: DataFrame, limit: Column) -> DataFrame:
    """session_id, answers_in_time and late: answers up to `limit` (an interval) after a session's first one, and those after it."""
    rows = answers.withColumn("__until", F.min("submitted_at").over(Window.partitionBy("session_id")) + limit)
    return rows.groupBy("session_id").agg(F.count_if(F.col("submitted_at") <= F.col("__until")).alias("answers_in_time"), F.count_if(F.col("submitted_at") > F.col("__until")).alias("late"))


def timing(events: DataFrame, limit: Column) -> DataFrame:
    """elapsed (whole seconds that have passed), total_elapsed (rounded), remaining and expired of each session, from its first and last time."""
    spans = events.groupBy("session_id").agg(F.min("submitted_at").alias("began"), F.max("submitted_at").alias("ended"))
    seconds = F.floor(F.unix_micros("ended") / 1e6 - F.unix_micros("began") / 1e6).cast("long")
    rounded = F.floor(F.unix_micros("ended") / 1e6 - F.unix_micros("began") / 1e6 + 0.5).cast("long")
    rows = spans.select("session_id", seconds.alias("elapsed"), rounded.alias("total_elapsed"))
    return rows.select("session_id", "elapsed", "total_elapsed", F.greatest(limit - F.col("elapsed"), F.lit(0)).alias("remaining"), ((limit > 0) & (F.col("elapsed") >= limit)).alias("expired"))


def result_rows(scored: DataFrame, study: str) -> DataFrame:
    """Scored sessions with received_at, their store key and sanitised ids; the key is grouped by the day of receipt.

    scored has received_at (a timestamp).
    """
    safe, session = tx.path_segment(F.lit(study)), tx.path_segment(F.col("session_id"))
    day = F.date_format("received_at", "yyyy-MM-dd")
    key = F.concat_ws("/", F.lit("study-results"), safe, day, F.concat(session, F.lit(".json")))
    return scored.withColumn("study_id", safe).withColumn("result_key", key).withColumn("session_id", session).withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def scale(low: Column, high: Column) -> Column:
    """Points of a rating scale, 1 to 5 by default."""
    return F.sequence(F.coalesce(low, F.lit(1)), F.coalesce(high, F.lit(5)))


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows replaced by the changes of the same key, others kept, new ones added."""
    return rows.join(changes.select(key).distinct().hint("merge"), key, "left_anti").unionByName(changes)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those of the given keys."""
    return rows.join(gone.select(key).distinct().hint("merge"), key, "left_anti")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows in order of their key (a range sort), with their place from 1 on as `place`; places need one more pass over the keys."""
    places = rows.select(key).distinct().repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    counted = materialize(places.select(key, "__part"), "places")
    before = counted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    numbered = counted.withColumn("__own", own).join(before.hint("merge"), "__part").select(key, (F.coalesce("__before", F.lit(0)) + F.col("__own")).alias("place"))
    return rows.join(numbered.hint("merge"), key).orderBy(key)


def normalise_exams(exams: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Exams with an id slug, a timing mode and limit, a condition, and questions with ids, choices and an answer among them.

    Only a question without any non-blank choice gets the two default ones. exams: id, fallback_id, document_id, title, question_set_id,
    enabled, timing_mode, time_limit_seconds (a string), condition_id, visible, questions (array of text, choices, answer_index; null
    entries are left out but counted); `kept` columns come along.
    """
    slug = lambda c: F.lower(tx.artifact_name(tx.stem(c)))
    blank = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    exam_id = slug(blank(F.col("id"), F.col("fallback_id")))
    limit = F.coalesce(tx.to_int(F.col("time_limit_seconds")), F.lit(0))
    asked = F.lower(F.trim(F.coalesce("timing_mode", F.lit(""))))
    mode = F.when(asked.isin("countdown", "stopwatch"), asked).when(limit > 0, "countdown").otherwise("stopwatch")

    def question(q: Column, k: Column) -> Column:
        kept = F.filter(F.coalesce(q["choices"], F.array().cast("array<string>")), lambda c: F.trim(c) != "")
        choices = F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, DEFAULT_CHOICES)))
        answer = F.least(F.greatest(F.coalesce(q["answer_index"], F.lit(0)), F.lit(0)), F.size(choices) - 1)
        number = (k + 1).cast("string")
        text = blank(q["text"], F.concat(F.lit("Question "), number))
        return F.when(q.isNotNull(), F.struct(F.concat(exam_id, F.lit("-q"), number).alias("question_id"), text.alias("text"), choices.alias("choices"), answer.alias("answer_index")))

    shown = F.filter(F.transform(F.coalesce("visible", F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return exams.select(
        exam_id.alias("exam_id"),
        slug(F.coalesce("document_id", F.lit(""))).alias("document_id"),
        blank(F.col("title"), exam_id).alias("title"),
        blank(F.col("question_set_id"), F.concat(exam_id, F.lit("-questions"))).alias("question_set_id"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        mode.alias("timing_mode"),
        F.when(mode == "stopwatch", 0).otherwise(limit).alias("time_limit_seconds"),
        blank(F.col("condition_id"), blank(F.array_join(shown, "-"), F.lit("none"))).alias("condition_id"),
        F.array_compact(F.transform("questions", question)).alias("questions"),
        *kept,
    )


def public_questions(exams: DataFrame) -> DataFrame:
    """Questions as participants see them: no answers."""
    return exams.select(F.explode("questions").alias("q")).select("q.question_id", "q.text", "q.choices")


def public_exams(exams: DataFrame) -> DataFrame:
    """Exams as participants see them: without questions, with the place of their public questions and their timing."""
    return exams.drop("questions", "enabled").withColumn("question_url", question_url(F.col("question_set_id")))


def enabled_exams(exams: DataFrame) -> DataFrame:
    """Exams that are to be exported; none at all is an error."""
    found = exams.where("enabled")
    if found.isEmpty():
        raise ValueError("no exam is enabled")
    return found


def private_keys(exams: DataFrame) -> DataFrame:
    return exams.select(F.explode("questions").alias("q")).select("q.question_id", "q.answer_index")
