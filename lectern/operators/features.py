"""Derived features of blocks: keywords, lead sentences, job tables, status, merges and incremental plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as tx
from lectern.operators.settings import STYLES, fixed_rows, profile_matches
from lectern.sources.responses import is_keywords, payload, response_text

# Words that are no keywords.
STOP_WORDS = "about after also been from into page that their there these they this were with".split()


def keywords_of(text: Column, count: int = 3) -> Column:
    """The most frequent tokens of a text, ties by first occurrence; `keyword pending` without one.

    All in the row. Most tokens of a text occur once, so only those that occur again are counted: they are found in the sorted tokens by one pattern, their runs
    are ranked, and the others follow in order of their first place.
    """
    # the two other characters whose small letters hold one of a to z belong to no token
    small = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" ")))
    # a stop word leaves the group empty
    tokens = F.array_remove(F.regexp_extract_all(small, F.lit(rf"(?:{'|'.join(STOP_WORDS)})(?![a-z0-9'-])|([a-z][a-z0-9'-]{{2,}}+)"), 1), "")

    def ranked(more: Column, firsts: Column) -> Column:
        """The tokens of `more` (sorted, each as often as it occurs again), by how often and by their place in firsts (each once)."""
        begins = F.array_compact(F.transform(more, lambda x, k: F.when((k == 0) | (F.get(more, k - 1) != x), k)))
        placed = F.sort_array(F.transform(firsts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def top(s: Column) -> Column:
            runs = F.transform(s["b"], lambda at, k: F.struct((at - F.coalesce(F.get(s["b"], k + 1), F.size(more))).alias("n"), F.get(s["p"], k)["i"].alias("i"), F.get(s["p"], k)["t"].alias("t")))
            return F.transform(F.slice(F.sort_array(runs), 1, count), lambda r: r["t"])

        return tx.once(F.struct(begins.alias("b"), placed.alias("p")), top)

    def best(s: Column) -> Column:
        frequent = F.when(F.size(s["again"]) > 0, ranked(s["again"], F.array_intersect(s["distinct"], s["again"]))).otherwise(F.slice(s["distinct"], 1, count))
        others = lambda f: F.slice(F.array_except(F.slice(s["distinct"], 1, 2 * count), f), 1, count - F.size(f))
        return tx.once(frequent, lambda f: F.when(F.size(f) < count, F.concat(f, others(f))).otherwise(f))

    again = lambda t: F.regexp_extract_all(F.array_join(F.sort_array(t), "\n"), F.lit(r"(?m)^(.++)\n(?=\1$)"), 1)
    found = tx.once(tokens, lambda t: tx.once(F.struct(again(t).alias("again"), F.array_distinct(t).alias("distinct")), best))
    return tx.once(found, lambda f: F.when(F.size(f) > 0, F.transform(f, lambda t: F.replace(t, F.lit("-"), F.lit(" ")))).otherwise(F.array(F.lit("keyword pending"))))


def keywords(blocks: DataFrame, keys: list[str], count: int = 3) -> DataFrame:
    """The keywords of each block."""
    return blocks.select(*keys, keywords_of(F.col("text"), count).alias("keywords"))


def default_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """A row of keywords and one of a lead sentence for each block."""
    kinds = F.array(
        F.struct(F.lit("keywords").alias("kind"), F.array_join(keywords_of(F.col("text")), ", ").alias("value")),
        F.struct(F.lit("summary").alias("kind"), tx.lead_sentence(F.col("text")).alias("value")),
    )
    return blocks.select(*keys, F.explode(kinds).alias("r")).select(*keys, "r.kind", "r.value")


def styled(rows: DataFrame) -> DataFrame:
    """Default rows with the label and style of their kind."""
    color, opacity = F.lit(None).cast("string"), F.lit(None).cast("double")
    for kind, (own_color, own_opacity) in STYLES.items():
        color = F.when(F.col("kind") == kind, own_color).otherwise(color)
        opacity = F.when(F.col("kind") == kind, F.lit(own_opacity)).otherwise(opacity)
    return rows.withColumn("label", tx.kind_label(F.col("kind"))).withColumn("color", color).withColumn("opacity", opacity)


def representations(blocks: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """The default rows of the blocks and enabled definitions whose word threshold a block exceeds, in one pass over the blocks.

    defs is the study's table of definitions; at most MOST_FIXED rows of it become part of the plan.
    """
    least = {r["kind"]: max(r["least_words"], 20) for r in fixed_rows(defs.where("enabled"))}
    words = blocks.select(*keys, "text", tx.word_count(F.col("text")).alias("__words"))
    kinds = {"keywords": F.array_join(keywords_of(F.col("text")), ", "), "summary": tx.lead_sentence(F.col("text"))}
    parts = [F.when(F.col("__words") > least[k], F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in kinds.items() if k in least]
    if not parts:
        return words.select(*keys, F.lit("").alias("kind"), F.lit("").alias("value")).limit(0)
    return words.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("r")).select(*keys, "r.kind", "r.value")


def from_responses(blocks: DataFrame, defs: DataFrame, responses: DataFrame, keys: list[str], ratio: float = 0.15, most: int = 5) -> DataFrame:
    """What responses to a block's tasks give: keys, kind, label, value, items, text, color, opacity and error, one row for each task that has a response.

    A task is an enabled definition whose word threshold the block exceeds (see plan_jobs); keywords are tidied and cut to `most`, texts to the block's
    target length; a response that gives nothing leaves no row, one that is wrong a row with its error. defs: kind, enabled, least_words, color,
    opacity, at most MOST_FIXED rows; responses: keys, kind, response (JSON text), joined by block.
    """
    rows = fixed_rows(defs.where("enabled"))
    if not rows:
        return blocks.select(*keys, *(F.lit("").alias(c) for c in ("kind", "label", "value"))).limit(0)
    words = tx.word_count(F.col("text"))
    style = lambda r: F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["color"]).alias("color"), F.lit(r["opacity"]).cast("double").alias("opacity"))
    tasks = blocks.select(*keys, words.alias("__words"))
    tasks = tasks.select(*keys, tx.target_words(F.col("__words"), ratio).alias("__target"), F.explode(F.array_compact(F.array(*[F.when(F.col("__words") > max(r["least_words"], 20), style(r)) for r in rows]))).alias("d")).select(*keys, "__target", "d.*")
    joined = tasks.join(responses.select(*keys, "kind", "response").hint("merge"), [*keys, "kind"])
    kind = F.col("kind")

    def tidied(error: Column, given: Column) -> Column:
        items = F.when(error.isNull() & is_keywords(kind), tx.clean_keywords(given["items"], most))
        return F.struct(items.alias("items"), F.when(error.isNull() & ~is_keywords(kind), tx.cap_summary(given["value"], F.col("__target"))).alias("text"), error.alias("error"))

    def kept(r: Column) -> Column:
        whole = lambda value: F.when(r["error"].isNotNull() | (value != ""), F.struct(r["items"].alias("items"), r["text"].alias("text"), r["error"].alias("error"), value.alias("value")))
        return tx.once(F.coalesce(F.array_join(r["items"], ", "), r["text"]), whole)

    # all of a response in one expression: a filter on what it gives would be moved below the join, and every step worked out again there
    given = lambda said: tx.once(payload(said["text"], kind), lambda p: tx.once(tidied(F.coalesce(said["error"], p["error"]), p), kept))
    found = joined.withColumn("__r", F.explode(F.array_compact(F.array(tx.once(response_text(F.col("response")), given)))))
    return found.select(*keys, "kind", tx.kind_label(kind).alias("label"), "__r.items", "__r.text", "color", "opacity", "__r.error", "__r.value")


def token_budget(kind: Column, target: Column) -> Column:
    """Output tokens of a single request: 2048 for keywords, else by the target words, between 2048 and 4096."""
    return F.when(kind == "keywords", 2048).otherwise(F.greatest(F.lit(2048), F.least(F.lit(4096), (target + 32) * 10)))


def retry_budgets(budget: Column, most: int = 8192) -> Column:
    """The budgets that a request is tried with, one after the other."""
    return F.when(budget >= most, F.array(budget)).otherwise(F.array(budget, F.lit(most)))


def batch_budgets(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Output tokens of each batch: tasks has keys, target (words) and most (keywords)."""
    wanted = (F.sum("target") + F.sum(F.col("most") * 4) + F.count(F.lit(1)) * 16) * 4
    return tasks.groupBy(*keys).agg(F.greatest(F.lit(2048), F.least(F.lit(8192), wanted)).cast("int").alias("budget"))


def batches(rows: DataFrame, keys: list[str], order: str, size: int = 12) -> DataFrame:
    """batch_no: consecutive rows in groups of a size (1 at least)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("batch_no", F.floor(place / max(size, 1)).cast("bigint"))


def restored(blocks: DataFrame, enabled: Column, keys: list[str]) -> DataFrame:
    """Default rows of the blocks for which models are off; the others are cleared, so they have none."""
    return default_rows(blocks.where(~enabled), keys)


def completed(state: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that are complete and have a result: those of `state` joined with `results` by keys."""
    return state.where("status = 'complete'").join(results.hint("merge"), keys)


def provider_of(rows: DataFrame, key: str, name: str, preferred: str) -> DataFrame:
    """The preferred provider of each key where it is there, else the first by name."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(name) == preferred, F.col(name))), F.min(name)).alias("provider"))


def definitions(spark: SparkSession) -> DataFrame:
    """The two default representation definitions (a fixed, small table)."""
    return spark.createDataFrame([(0, "keywords", True, 20), (1, "summary", True, 35)], "pos int, kind string, enabled boolean, least_words int")


#: Word counts that thresholds above FEW definitions are looked up by share a bucket of so many words; the last bucket has all above.
FEW, BUCKET_WORDS, BUCKETS = 64, 16, 256


def plan_jobs(blocks: DataFrame, defs: DataFrame) -> DataFrame:
    """A pending job for each block and enabled definition whose word threshold the block exceeds. defs: kind, enabled, least_words.

    A few definitions are looked up in the row; more are dealt to the buckets of word counts that may exceed them, so that a block meets those of its
    bucket only.
    """
    rows = blocks.withColumn("words", tx.word_count(F.col("text")))
    known = defs.where("enabled").select("kind", F.greatest("least_words", F.lit(20)).alias("__least"))
    few = known.limit(FEW + 1).collect()
    if not few:
        rows = rows.withColumn("kind", F.lit("")).limit(0)
    elif len(few) <= FEW:
        rows = rows.withColumn("kind", F.explode(F.array_compact(F.array(*[F.when(F.col("words") > r["__least"], r["kind"]) for r in few]))))
    else:
        bucket = lambda n: F.least(F.floor(n / BUCKET_WORDS).cast("int"), F.lit(BUCKETS - 1))
        dealt = known.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__least")), F.lit(BUCKETS - 1))))
        rows = rows.withColumn("__bucket", bucket(F.col("words"))).join(dealt.hint("merge"), "__bucket").where("words > __least")
    return rows.select("document_id", "block_id", "kind", F.concat_ws(":", "block_id", "kind").alias("job_id"), F.lit("pending").alias("status"), "words")


def job_headers(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """The row that a document's job table begins with: document_id, status (`pending`, or `complete` where there is no job), total_jobs, completed_jobs, failed_jobs,
    running_jobs and pending_jobs."""
    counted = jobs.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = documents.select("document_id").distinct().join(counted.hint("merge"), "document_id", "left").withColumn("total_jobs", F.coalesce("__n", F.lit(0)))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("completed_jobs", "failed_jobs", "running_jobs")]
    return rows.select("document_id", F.when(F.col("total_jobs") > 0, "pending").otherwise("complete").alias("status"), "total_jobs", *none, F.col("total_jobs").alias("pending_jobs"))


def quiz_text(documents: DataFrame, blocks: DataFrame, most: int = 6000) -> DataFrame:
    """document_id, text and error: the texts of a document's blocks (document_id, block_no, text) in order, a blank line between them, cut at `most` characters; a
    document without any text has an error."""
    own = blocks.where(F.coalesce("text", F.lit("")) != "").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("__p"))
    joined = documents.select("document_id").distinct().join(own.hint("merge"), "document_id", "left")
    whole = F.array_join(F.transform("__p", lambda x: x["text"]), "\n\n")
    rows = joined.withColumn("text", F.when(F.rlike(whole, F.lit(r"(?U)\S")), F.left(whole, F.lit(most))))
    return rows.select("document_id", "text", F.when(F.col("text").isNull(), "the document has no text").alias("error"))


def quiz_questions(json: Column, most: int = 3) -> Column:
    """The first questions of a quiz (JSON text with a list `questions` of text, choices, answer_index), an empty array if there is none."""
    parsed = F.from_json(json, "questions array<struct<text:string,choices:array<string>,answer_index:int>>")
    return F.slice(F.coalesce(parsed["questions"], F.array().cast("array<struct<text:string,choices:array<string>,answer_index:int>>")), 1, most)


def counters(blocks: DataFrame, results: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """eligible, generated and skipped blocks of each document: those with a job, those with any result, those without a job."""
    least = min((max(r["least_words"], 20) for r in fixed_rows(defs.where("enabled"))), default=None)
    eligible = tx.word_count(F.col("text")) > least if least is not None else F.lit(False)
    have = results.select(*keys).distinct().withColumn("__have", F.lit(True))
    rows = blocks.select(*keys, eligible.alias("__eligible")).join(have.hint("merge"), keys, "left")
    return rows.groupBy(keys[0]).agg(F.count_if("__eligible").alias("eligible"), F.count_if(F.col("__have")).alias("generated"), F.count_if(~F.col("__eligible")).alias("skipped"))


def names(prompts: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, pos, name: names of a document's prompts, then its blocks' kinds, then the two defaults; trimmed, the first sight of each.

    prompts: document_id, pos, name; blocks: document_id, pos, kind; documents: document_id.
    """
    default = documents.select("document_id", F.posexplode(F.array(F.lit("keywords"), F.lit("summary"))).alias("pos", "name"))
    parts = [prompts.select("document_id", "pos", "name"), blocks.select("document_id", "pos", F.col("kind").alias("name")), default]
    every = None
    for rank, part in enumerate(parts):
        own = part.select("document_id", F.struct(F.lit(rank).alias("source"), F.col("pos").cast("long").alias("pos")).alias("seen"), F.trim("name").alias("name")).where("name <> ''")
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("document_id", "name").agg(F.min("seen").alias("seen"))
    order = Window.partitionBy("document_id").orderBy("seen")
    return first.select("document_id", F.row_number().over(order).alias("pos"), "name")


def first_of_kind(blocks: DataFrame) -> DataFrame:
    """The first representation of each kind of a document in block order: document_id, kind, value. blocks: document_id, pos, kind, value."""
    return blocks.where("kind <> ''").groupBy("document_id", "kind").agg(F.min_by("value", "pos").alias("value"))


def cache_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """document_id and action of each request: parse, restart, adopt, resume or keep.

    requests: document_id, version, cache_profile, enabled, representation_profile, default_profile (that of the same settings with the
    default definitions); cache: document_id, version, cache_profile, representation_profile (null: from before there were any),
    status, failed. A cache of another version or parser profile is parsed anew; one whose representation profile differs has its
    jobs restarted; an old one without a profile is adopted if it is complete under the default definitions, or switched off; what is
    the same resumes its failed and pending jobs, or is kept where there is none or models are off.
    """
    stored = cache.select("document_id", *(F.col(c).alias(f"__{c}") for c in ("version", "cache_profile", "representation_profile", "status", "failed")))
    rows = requests.join(stored.hint("merge"), "document_id", "left")
    usable = F.coalesce(F.col("__version") == F.col("version"), F.lit(False)) & profile_matches(F.coalesce("__cache_profile", F.lit("")), F.col("cache_profile"))
    none = F.coalesce("__representation_profile", F.lit("")) == ""
    complete = (F.col("__status") == "complete") & (F.coalesce("__failed", F.lit(0)) == 0)
    adopt = F.when(F.col("enabled"), F.coalesce(complete, F.lit(False)) & (F.col("representation_profile") == F.col("default_profile"))).otherwise(F.col("representation_profile") == "placeholder")
    same = F.col("__representation_profile").eqNullSafe(F.col("representation_profile"))
    open_jobs = F.col("enabled") & ~F.coalesce(complete, F.lit(False))
    action = F.when(~usable, "parse").when(none & adopt, "adopt").when(none | ~same, "restart").when(open_jobs, "resume").otherwise("keep")
    return rows.select("document_id", action.alias("action"))


def preparation_summary(documents: DataFrame, rolled: DataFrame) -> DataFrame:
    """One row for each prepared document: ids and paths, page count, provider, job counts and status, title.

    documents: document_id, provider, page_count, title; rolled: rollup() of its jobs.
    """
    jobs = rolled.select("document_id", "total", "complete", "failed", "status")
    joined = documents.join(jobs.hint("merge"), "document_id", "left")
    provider = F.coalesce(F.nullif("provider", F.lit("")), F.lit("tagged"))
    folder = F.concat(F.lit("prepared/"), F.col("document_id").cast("string"))
    return joined.select(
        "document_id",
        F.concat(folder, F.lit("/providers/"), provider, F.lit("/document.json")).alias("document_json"),
        "page_count",
        provider.alias("provider"),
        F.col("complete").alias("completed_jobs"),
        F.col("failed").alias("failed_jobs"),
        "status",
        F.col("total").alias("total_jobs"),
        F.concat(folder, F.lit("/source.pdf")).alias("source_pdf"),
        "title",
    )


def request_text(kind: Column, text: Column, target: Column, most: Column | int, instruction: Column) -> Column:
    """What a model is asked: key phrases, a summary of the target length, or a value of any other kind by its own instruction."""
    most = most if isinstance(most, Column) else F.lit(most)
    custom = F.coalesce(F.nullif(F.trim(F.coalesce(instruction, F.lit(""))), F.lit("")), F.lit("Describe the text."))
    return (
        F.when(kind == "keywords", F.format_string('Return JSON {"k": [...]} with up to %d key phrases of: %s', most, text))
        .when(kind == "summary", F.format_string('Return JSON {"s": "..."} of about %d words on: %s', target, text))
        .otherwise(F.concat(custom, F.lit(' Return JSON {"v": "..."} for: '), text))
    )


def latest(events: DataFrame, keys: list[str], order_col: str, value: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, order_col).alias(value))


def rollup(state: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, and the status of the whole."""
    names = ("complete", "failed", "running", "pending")
    rows = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in names))
    ended = F.col("complete") + F.col("failed") == F.col("total")
    return rows.withColumn("status", F.when(ended & (F.col("failed") > 0), "failed").when(ended, "complete").otherwise("pending"))


def progress(rolled: DataFrame) -> DataFrame:
    """done, percent, waiting, label and variant of each rollup."""
    done = F.col("complete") + F.col("failed")
    text = lambda form, *names: F.format_string(form, *names)
    label = (
        F.when(F.col("total") == 0, "No jobs")
        .when(F.col("status") == "failed", text("Failed %d/%d", "failed", "total"))
        .when(F.col("status") == "complete", text("Done %d/%d", "complete", "total"))
        .when(F.col("running") > 0, text("%d/%d, %d running", "complete", "total", "running"))
        .otherwise(text("%d/%d", "complete", "total"))
    )
    return rolled.select(
        "*",
        done.alias("done"),
        tx.percent(done, F.col("total")).alias("percent"),
        F.greatest(F.col("total") - done - F.col("running"), F.lit(0)).alias("waiting"),
        F.when(F.col("status") == "failed", "danger").when(F.col("status") == "complete", "success").otherwise("info").alias("variant"),
        label.alias("label"),
    )


def first_errors(state: DataFrame, key: str, order: list[str], most: int = 10) -> DataFrame:
    """At most ten failed jobs with an error text of each key, in job order. state has status and error."""
    failed = state.where((F.col("status") == "failed") & (F.coalesce("error", F.lit("")) != ""))
    return failed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def failure_signature() -> Column:
    """What tells failures apart: the document and the kind."""
    return F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), "kind"), 256)


def first_failures(events: DataFrame) -> DataFrame:
    """signature and first_pos of every failure that events tell of, once each."""
    return events.where("status = 'failed'").groupBy(failure_signature().alias("signature")).agg(F.min("pos").alias("first_pos"))


def reset_for_retry(status: Column) -> Column:
    return F.when(status.isin("failed", "running"), "pending").otherwise(status)


def fail_pending(status: Column) -> Column:
    return F.when(status.isin("pending", "running"), "failed").otherwise(status)


def runnable(state: DataFrame, blocks: DataFrame, keys: list[str], retry: bool) -> DataFrame:
    """Jobs to run, and jobs whose block is gone with their error."""
    wanted = state.where(F.col("status").isin(["pending", "failed"] if retry else ["pending"]))
    marked = wanted.join(blocks.select(*keys).distinct().withColumn("__there", F.lit(True)).hint("merge"), keys, "left")
    there = F.coalesce("__there", F.lit(False))
    return marked.withColumn("action", F.when(there, "run").otherwise("fail")).withColumn("error", F.when(~there, "Block no longer exists.")).drop("__there")


def replace_by_block(blocks: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """A block with any result takes the results' list; other blocks keep theirs."""
    joined = blocks.alias("b").join(results.select(*keys, F.col("representations").alias("__new")).hint("merge"), keys, "left")
    return joined.withColumn("representations", F.coalesce("__new", "representations")).drop("__new")


def merge_by_kind(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Same kinds replaced in place, new kinds appended, others kept; `changed` tells replaced or added rows."""
    o = old.select(*keys, "kind", F.col("pos").alias("__op"), F.col("value").alias("__ov"))
    n = new.select(*keys, "kind", F.col("pos").alias("__np"), F.col("value").alias("__nv"))
    joined = o.join(n.hint("merge"), [*keys, "kind"], "full_outer")
    return joined.select(
        *keys,
        "kind",
        F.coalesce("__op", F.col("__np") + 1_000_000).alias("pos"),
        F.coalesce("__nv", "__ov").alias("value"),
        (F.col("__nv").isNotNull() & ~F.col("__nv").eqNullSafe(F.col("__ov"))).alias("changed"),
    )


def fingerprint(config: DataFrame, columns: list[str], enabled: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the key-sorted JSON; `placeholder` when off."""
    return F.when(enabled, F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)).otherwise("placeholder")
