"""Queries of derived features, jobs and overlays (inventory F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import features, overlays
from lectern.plans import views
from lectern.plans.registry import query
from lectern.plans.text_queries import C, block_rows, blocks_of, documents, events

WORDS = "len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]*'))"
STOPS = ", ".join(f"'{w}'" for w in features.STOP_WORDS)
KEYWORDS = f"""
tk AS (SELECT document_id, block_no, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{2,}}'), 1) AS pos, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{2,}}'))) AS token FROM blocks),
tc AS (SELECT document_id, block_no, token, count(*) AS n, min(pos) AS pos FROM tk WHERE token NOT IN ({STOPS}) GROUP BY 1, 2, 3),
tr AS (SELECT *, row_number() OVER (PARTITION BY document_id, block_no ORDER BY n DESC, pos) AS rank FROM tc),
kw AS (SELECT b.document_id, b.block_no, coalesce(string_agg(replace(token, '-', ' '), ', ' ORDER BY rank), 'keyword pending') AS keywords FROM blocks b LEFT JOIN tr ON b.document_id = tr.document_id AND b.block_no = tr.block_no AND rank <= 3 GROUP BY 1, 2)
"""
LEAD = f"""CASE WHEN {C} = '' THEN 'summary pending' ELSE (SELECT CASE WHEN length(s) <= 120 THEN s ELSE rtrim(regexp_replace(substr(s, 1, 120), '\\s+\\S*$', ''), ' .,:;') || '...' END FROM (SELECT coalesce(nullif(regexp_extract({C}, '^(.*?[.!?])\\s', 1), ''), {C}) AS s)) END"""


def keyed(spark, sf_dir):
    return block_rows(spark, sf_dir).withColumn("block_id", F.col("block_no").cast("string"))


@query("f1_keywords", f"WITH {views.BLOCKS}, {KEYWORDS} SELECT document_id, block_no, keywords FROM kw")
def f1(spark, sf_dir):
    found = features.keywords(block_rows(spark, sf_dir), ["document_id", "block_no"])
    return found.select("document_id", "block_no", F.array_join("keywords", ", ").alias("keywords"))


@query("f2_lead_sentence", f"WITH {views.BLOCKS} SELECT document_id, block_no, {LEAD} AS summary FROM blocks")
def f2(spark, sf_dir):
    return block_rows(spark, sf_dir).select("document_id", "block_no", tx.lead_sentence(F.col("text")).alias("summary"))


@query("f3_default_rows", f"WITH {views.BLOCKS}, {KEYWORDS}, d AS (SELECT document_id, block_no, 'keywords' AS kind, keywords AS value FROM kw UNION ALL SELECT document_id, block_no, 'summary', {LEAD} FROM blocks) SELECT *, CASE kind WHEN 'keywords' THEN 'Keywords' ELSE 'Summary' END AS label, CASE kind WHEN 'keywords' THEN '#7a4a12' ELSE '#263238' END AS color, CAST(1 AS DOUBLE) AS opacity FROM d")
def f3(spark, sf_dir):
    return features.styled(features.default_rows(block_rows(spark, sf_dir), ["document_id", "block_no"]))


@query("f4_jobs", f"WITH {views.BLOCKS}, d(kind, least) AS (VALUES ('keywords', 20), ('summary', 35)), n AS (SELECT *, {WORDS} AS words FROM blocks) SELECT document_id, CAST(block_no AS VARCHAR) AS block_id, kind, block_no || ':' || kind AS job_id, 'pending' AS status, words FROM n JOIN d ON words > least")
def f4(spark, sf_dir):
    return features.plan_jobs(keyed(spark, sf_dir), features.definitions(spark))


@query("f4_headers", f"WITH {views.BLOCKS}, d(kind, least) AS (VALUES ('keywords', 20), ('summary', 35)), n AS (SELECT *, {WORDS} AS words FROM blocks), j AS (SELECT document_id, count(*) AS c FROM n JOIN d ON words > least GROUP BY 1) SELECT doc_id AS document_id, CASE WHEN c IS NULL THEN 'complete' ELSE 'pending' END AS status, coalesce(c, 0) AS total_jobs, CAST(0 AS BIGINT) AS completed_jobs, CAST(0 AS BIGINT) AS failed_jobs, CAST(0 AS BIGINT) AS running_jobs, coalesce(c, 0) AS pending_jobs FROM documents LEFT JOIN j ON document_id = doc_id")
def f4_headers(spark, sf_dir):
    """The first row of each document's job table."""
    jobs = features.plan_jobs(keyed(spark, sf_dir), features.definitions(spark))
    return features.job_headers(documents(spark, sf_dir).select(F.col("doc_id").alias("document_id")), jobs)


@query("f5_words", f"WITH {views.BLOCKS}, n AS (SELECT *, {WORDS} AS words FROM blocks) SELECT document_id, block_no, words, greatest(8, CAST(ceil(CAST(words AS DOUBLE) * CAST(0.25 AS DOUBLE)) AS INT)) AS target FROM n")
def f5(spark, sf_dir):
    words = tx.word_count(F.col("text"))
    return block_rows(spark, sf_dir).select("document_id", "block_no", words.alias("words"), tx.target_words(words, 0.25).alias("target"))


@query("f6_batches", f"WITH {views.BLOCKS} SELECT document_id, block_no, (row_number() OVER (PARTITION BY document_id ORDER BY block_no) - 1) // 12 AS batch_no FROM blocks")
def f6(spark, sf_dir):
    return features.batches(block_rows(spark, sf_dir).select("document_id", "block_no"), ["document_id"], "block_no")


@query(
    "f7_representations",
    f"WITH {views.BLOCKS}, {KEYWORDS}, n AS (SELECT *, {WORDS} AS words FROM blocks) SELECT document_id, block_no, 'keywords' AS kind, keywords AS value FROM kw JOIN n USING (document_id, block_no) WHERE words > 20 UNION ALL SELECT document_id, block_no, 'summary', {LEAD} FROM n WHERE words > 35",
)
def f7(spark, sf_dir):
    """Chunks to paragraphs to eligible jobs to keywords and lead sentences: the library end to end."""
    return features.representations(block_rows(spark, sf_dir), features.definitions(spark), ["document_id", "block_no"])


KEYS = ["document_id", "block_no", "kind"]


def state(spark, sf_dir):
    return features.latest(views.jobs(spark, sf_dir), KEYS, "pos", "status")


ROLLED = (
    views.JOBS
    + ", rolled AS (SELECT document_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending FROM state GROUP BY 1),"
    " rs AS (SELECT *, CASE WHEN complete + failed = total AND failed > 0 THEN 'failed' WHEN complete + failed = total THEN 'complete' ELSE 'pending' END AS status FROM rolled)"
)


@query("f9_status_rollup", f"WITH {ROLLED} SELECT * FROM rs")
def f9(spark, sf_dir):
    return features.rollup(state(spark, sf_dir), ["document_id"])


@query("f10_first_errors", f"WITH {views.JOBS}, l AS (SELECT document_id, block_no, kind, arg_max(status, pos) AS status, max(pos) AS pos FROM jobs GROUP BY 1, 2, 3), e AS (SELECT document_id, block_no, kind, status, CASE WHEN pos % 3 = 0 THEN 'no answer' WHEN pos % 3 = 1 THEN 'cut off' END AS error FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_no, kind) AS rank FROM e WHERE status = 'failed' AND error IS NOT NULL) SELECT * FROM r WHERE rank <= 10")
def f10(spark, sf_dir):
    """Two thirds of the failed jobs have an error text, the others a blank one or none."""
    n = F.col("pos")
    told = F.struct("status", F.when(n % 3 == 0, "no answer").when(n % 3 == 1, "cut off").when(n % 2 == 0, "").alias("error"))
    last = features.latest(views.jobs(spark, sf_dir).withColumn("s", told), KEYS, "pos", "s")
    return features.first_errors(last.select(*KEYS, "s.*"), "document_id", ["block_no", "kind"])


@query("f11_progress", f"WITH {ROLLED} SELECT *, complete + failed AS done, CASE WHEN total > 0 THEN CAST(round(100.0 * (complete + failed) / total) AS INT) ELSE 0 END AS percent, greatest(total - complete - failed - running, 0) AS waiting, CASE status WHEN 'failed' THEN 'danger' WHEN 'complete' THEN 'success' ELSE 'info' END AS variant, CASE WHEN status = 'failed' THEN 'Failed ' || failed || '/' || total WHEN status = 'complete' THEN 'Done ' || complete || '/' || total WHEN running > 0 THEN complete || '/' || total || ', ' || running || ' running' ELSE complete || '/' || total END AS label FROM rs")
def f11(spark, sf_dir):
    return features.progress(features.rollup(state(spark, sf_dir), ["document_id"]))


@query("f12_retry_reset", f"WITH {views.JOBS} SELECT document_id, block_no, kind, CASE WHEN status IN ('failed', 'running') THEN 'pending' ELSE status END AS status FROM state")
def f12(spark, sf_dir):
    return state(spark, sf_dir).withColumn("status", features.reset_for_retry(F.col("status")))


@query("f13_fail_pending", f"WITH {views.JOBS} SELECT document_id, block_no, kind, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status FROM state")
def f13(spark, sf_dir):
    return state(spark, sf_dir).withColumn("status", features.fail_pending(F.col("status")))


@query("f14_runnable", f"WITH {views.JOBS} SELECT s.document_id, s.block_no, s.kind, s.status, CASE WHEN d.doc_id IS NULL THEN 'fail' ELSE 'run' END AS action, CASE WHEN d.doc_id IS NULL THEN 'Block no longer exists.' END AS error FROM state s LEFT JOIN documents d ON d.doc_id = s.document_id AND d.lang = 'en' WHERE status IN ('pending', 'failed')")
def f14(spark, sf_dir):
    there = documents(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    return features.runnable(state(spark, sf_dir), there, ["document_id"], True)


@query("f15_job_state", f"WITH {views.JOBS} SELECT * FROM state")
def f15(spark, sf_dir):
    return state(spark, sf_dir)


@query("f16_completed", f"WITH {views.JOBS} SELECT document_id, block_no, kind, d.source AS result FROM state JOIN documents d ON d.doc_id = document_id WHERE status = 'complete'")
def f16(spark, sf_dir):
    results = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("result"))
    return features.completed(state(spark, sf_dir), results, ["document_id"]).select(*KEYS, "result")


@query(
    "f18_merge_by_kind",
    "WITH o AS (SELECT user_id, event_type AS kind, min(event_id) AS pos, arg_min(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type AS kind, min(event_id) AS pos, arg_min(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"
    " SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.kind, n.kind) AS kind, coalesce(o.pos, n.pos + 1000000) AS pos, coalesce(n.value, o.value) AS value, n.value IS NOT NULL AND n.value IS DISTINCT FROM o.value AS changed FROM o FULL JOIN n ON o.user_id = n.user_id AND o.kind = n.kind",
)
def f18(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("pos"), "value")
    part = lambda odd: rows.where(F.col("pos") % 2 == odd).groupBy("user_id", "kind").agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"))
    return features.merge_by_kind(part(0), part(1), ["user_id"])


@query("f20_fingerprint", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'placeholder' ELSE substr(sha256(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')), 1, 16) END AS fingerprint FROM events""")
def f20(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", features.fingerprint(rows, ["user_id", "event_type"], F.col("event_id") % 4 != 0).alias("fingerprint"))


@query("f24_quiz_text", f"WITH {views.BLOCKS}, t AS (SELECT document_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY block_no), 1, 6000) AS text FROM blocks WHERE trim(text) <> '' AND document_id % 10 <> 3 GROUP BY 1) SELECT doc_id AS document_id, t.text, CASE WHEN t.text IS NULL THEN 'the document has no text' END AS error FROM documents LEFT JOIN t ON document_id = doc_id")
def f24(spark, sf_dir):
    """Every tenth document's blocks are blank."""
    blocks = block_rows(spark, sf_dir).withColumn("text", F.when(F.col("document_id") % 10 != 3, F.col("text")).otherwise(" "))
    return features.quiz_text(documents(spark, sf_dir).select(F.col("doc_id").alias("document_id")), blocks)


@query("f24_quiz_questions", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE array_to_string(list_transform(range(1, least(event_id % 6, 3) + 1), lambda k: 'Q' || k || '?' || (k - 1)), ';') END AS questions FROM events")
def f24_questions(spark, sf_dir):
    """Answers with none to four questions, and some that are no JSON."""
    n = F.col("event_id") % 6
    asked = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(F.concat(F.lit("Q"), k.cast("string"), F.lit("?")).alias("text"), F.array(F.lit("a"), F.lit("b")).alias("choices"), (k - 1).alias("answer_index")))
    json = F.when(n == 5, "none").when(n == 0, '{"questions": null}').otherwise(F.to_json(F.struct(asked.alias("questions"))))
    shown = F.transform(features.quiz_questions(json), lambda q: F.concat(q["text"], q["answer_index"].cast("string")))
    return events(spark, sf_dir).select("event_id", F.array_join(shown, ";").alias("questions"))


OVER = views.BLOCKS + ", un AS (SELECT document_id, block_no, generate_subscripts(chunk_ids, 1) - 1 AS pos, unnest(chunk_ids) AS chunk_id FROM blocks), ov AS (SELECT un.document_id, CAST(un.block_no AS VARCHAR) AS block_id, un.pos, chunk_id, c.page_number, c.x, c.y, c.width, c.height, c.reading_order FROM un JOIN chunks c USING (document_id, chunk_id))"


def overlay_table(spark, sf_dir):
    """Both sides begin with the same exchange of the chunks by document, which Spark reuses."""
    chunks = views.chunks(spark, sf_dir)
    return overlays.overlay_rows(blocks_of(chunks).withColumn("block_id", F.col("block_no").cast("string")), chunks)


@query("g1_overlays", f"WITH {OVER} SELECT document_id, block_id, chunk_id, block_id || ':' || chunk_id AS overlay_id, row_number() OVER (PARTITION BY document_id, block_id ORDER BY pos) = 1 AS has_label FROM ov")
def g1(spark, sf_dir):
    return overlay_table(spark, sf_dir).select("document_id", "block_id", "chunk_id", "overlay_id", "has_label")


@query("g2_unmapped", f"WITH {OVER} SELECT document_id, chunk_id, 'unmapped:' || chunk_id AS overlay_id FROM chunks ANTI JOIN (SELECT ov.* FROM ov JOIN blocks b ON b.document_id = ov.document_id AND CAST(b.block_no AS VARCHAR) = ov.block_id WHERE {WORDS.replace('text', 'b.text')} > 20) o USING (document_id, chunk_id)")
def g2(spark, sf_dir):
    """Chunks of blocks too short for any job stand in no overlay."""
    chunks = views.written_chunks(spark, sf_dir)
    long = blocks_of(chunks).where(tx.word_count(F.col("text")) > 20).withColumn("block_id", F.col("block_no").cast("string"))
    return overlays.unmapped(chunks, overlays.overlay_rows(long, chunks)).select("document_id", "chunk_id", "overlay_id")


@query("g3_page_order", f"WITH {OVER}, pl AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y, x, block_id || ':' || chunk_id) AS place FROM ov), ct AS (SELECT document_id, page_number, count(DISTINCT block_id) AS blocks FROM ov GROUP BY 1, 2) SELECT document_id, page_number, block_id || ':' || chunk_id AS overlay_id, place, blocks FROM pl JOIN ct USING (document_id, page_number)")
def g3(spark, sf_dir):
    return overlays.page_order(overlay_table(spark, sf_dir)).select("document_id", "page_number", "overlay_id", "place", "blocks")


GEOM = "greatest(width * 760 - 4, 1)"


@query("g5_regions", f"WITH {OVER} SELECT document_id, block_id, chunk_id, round({GEOM}, 6) AS w, round(greatest(height * 980 - 4, 1), 6) AS h, round(page_number * 100000.0 + y * 1000 + x + pos * 0.0001, 6) AS ord FROM ov")
def g5(spark, sf_dir):
    found = overlay_table(spark, sf_dir).select("document_id", "block_id", "chunk_id", overlays.region(F.col("width"), F.col("height"), F.col("page_number"), F.col("x"), F.col("y"), F.col("pos")).alias("r"))
    return found.select("document_id", "block_id", "chunk_id", *(F.round(f"r.{c}", 6).alias(c) for c in ("w", "h", "ord")))


@query("g6_summary_height", f"WITH {views.BLOCKS} SELECT document_id, block_no, CAST(least(greatest(CAST(ceil(length(text) * 7.0 / 284) AS INT), 1), 3) * 18 + 10 AS DOUBLE) AS height FROM blocks")
def g6(spark, sf_dir):
    return block_rows(spark, sf_dir).select("document_id", "block_no", overlays.summary_height(F.col("text"), F.lit(300.0)).alias("height"))


CHIPS = """RECURSIVE it AS (SELECT document_id, block_no, row_number() OVER (PARTITION BY document_id, block_no ORDER BY i) AS n, least(length(x) * CAST(7.2 AS DOUBLE) + 14, 300) AS chip FROM (SELECT document_id, block_no, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS x FROM (SELECT document_id, block_no, replace(text, ' of ', '  ') AS text FROM blocks)) WHERE x <> ''),
 fl AS (SELECT document_id, block_no, n, 1 AS rows, chip AS used FROM it WHERE n = 1 UNION ALL SELECT it.document_id, it.block_no, it.n, CASE WHEN f.used + 4 + chip > 300 THEN f.rows + 1 ELSE f.rows END, CASE WHEN f.used + 4 + chip > 300 THEN chip ELSE f.used + 4 + chip END FROM fl f JOIN it ON it.document_id = f.document_id AND it.block_no = f.block_no AND it.n = f.n + 1)"""


@query("g7_chip_rows", f"WITH {CHIPS.replace('RECURSIVE it', 'RECURSIVE ' + views.BLOCKS + ', it')} SELECT b.document_id, b.block_no, CAST(coalesce(max(rows), 1) * 23 + (coalesce(max(rows), 1) - 1) * 4 AS DOUBLE) AS height FROM blocks b LEFT JOIN fl ON fl.document_id = b.document_id AND fl.block_no = b.block_no GROUP BY 1, 2")
def g7(spark, sf_dir):
    """A block's words as chips; a word taken out leaves an empty one."""
    items = F.split(F.replace(F.col("text"), F.lit(" of "), F.lit("  ")), " ")
    return block_rows(spark, sf_dir).select("document_id", "block_no", overlays.chips_height(items, F.lit(300.0)).alias("height"))


@query(
    "g8_best_layout",
    f"""WITH {OVER}, rg AS (SELECT document_id, block_id, pos AS idx, page_number, y, {GEOM} AS w, greatest(height * 980 - 4, 1) AS h, page_number * 100000.0 + y * 1000 + x + pos * 0.0001 AS ord, CAST(28 AS DOUBLE) AS ns, CAST(23 AS DOUBLE) AS nk FROM ov),
    pr AS (SELECT s.document_id, s.block_id, s.idx AS si, k.idx AS ki, CASE WHEN s.idx = k.idx THEN (CASE WHEN 55 <= s.h THEN 10000.0 ELSE 0 END + 100 * least(s.h / 55, 4) + s.w * s.h / 1000 - 40 * greatest(55 - s.h, 0) - s.ord / 100) + 20
     ELSE (CASE WHEN s.ns <= s.h THEN 10000.0 ELSE 0 END + 100 * least(s.h / s.ns, 4) + s.w * s.h / 1000 - 40 * greatest(s.ns - s.h, 0) - s.ord / 100) + (CASE WHEN k.nk <= k.h THEN 10000.0 ELSE 0 END + 100 * least(k.h / k.nk, 4) + k.w * k.h / 1000 - 40 * greatest(k.nk - k.h, 0) - k.ord / 100) - 0.02 * abs(k.ord - s.ord) END AS score
     FROM rg s JOIN rg k USING (document_id, block_id) WHERE k.page_number > s.page_number OR (k.page_number = s.page_number AND k.y >= s.y - 0.001)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY document_id, block_id ORDER BY round(score, 6) DESC, si, ki) AS rank FROM pr) SELECT document_id, block_id, si AS summary_at, ki AS keywords_at, round(score, 4) AS score FROM rk WHERE rank = 1""",
)
def g8(spark, sf_dir):
    rows = overlay_table(spark, sf_dir)
    area = overlays.region(F.col("width"), F.col("height"), F.col("page_number"), F.col("x"), F.col("y"), F.col("pos"))
    regions = rows.withColumn("r", area).select("document_id", "block_id", F.col("pos").alias("idx"), "page_number", "y", "r.w", "r.h", "r.ord", F.lit(28.0).alias("need_s"), F.lit(23.0).alias("need_k"))
    return overlays.best_layout(regions, ["document_id", "block_id"]).withColumn("score", F.round("score", 4))
