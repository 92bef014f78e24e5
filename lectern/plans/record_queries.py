"""Queries of records as they are saved and exchanged: files, settings, edits, groups, alignment, plans and exams.

The inputs are derived from all rows of the shared tables, with edge cases spread over them; the SQL states the expected rows on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import alignment, features, layout, overlays, settings, study, windows
from lectern.plans import views
from lectern.plans.feature_queries import KEYWORDS, LEAD, ROLLED, STOPS, WORDS, state
from lectern.plans.registry import query
from lectern.plans.structure_queries import ASSEMBLED, PACKED, roled
from lectern.plans.study_queries import SCORED
from lectern.plans.text_queries import C, blocks_of, block_rows, documents, events, pages
from lectern.sources import elements, markup, records



def none():
    return F.array().cast("array<string>")



@query("a1_intake", "SELECT sha256(c) AS document_id, name AS source_name, strlen(c) AS n_bytes FROM (SELECT text AS c, source AS name FROM documents UNION ALL SELECT html, url FROM pages) WHERE starts_with(c, '<!DOCTYPE')")
def a1(spark, sf_dir):
    """Texts and pages as files; only the pages begin with the magic bytes."""
    files = documents(spark, sf_dir).select(F.col("text").alias("content"), F.col("source").alias("name")).unionByName(pages(spark, sf_dir).select(F.col("html").alias("content"), F.col("url").alias("name")))
    return markup.intake(files, "content", "name", "<!DOCTYPE").where(markup.valid_id(F.col("document_id")))


LINES = f"ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents), lt AS (SELECT doc_id, n, replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(line, ', '), lambda x: trim(regexp_replace(x, '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '-\\n(\\p{{Ll}})', '\\1', 'g'), chr(10), ' ') AS text FROM ln)"


@query(
    "a7_span_scan",
    f"WITH {LINES} SELECT doc_id AS document_id, CAST(n // 20 + 1 AS INT) AS page_number, format('chunk-{{:03d}}-{{:04d}}', n // 20 + 1, row_number() OVER (PARTITION BY doc_id, n // 20 ORDER BY n)) AS chunk_id, text, round(10 * (n % 3) / 400.0, 6) AS x, round(5 * (n % 20) / 100.0, 6) AS y, CAST(0.25 AS DOUBLE) AS width, CAST(0.04 AS DOUBLE) AS height, CAST(10 + n % 4 AS DOUBLE) AS font_size, n % 5 = 0 AS is_bold FROM lt WHERE text <> '' AND n % 9 <> 8 AND n % 7 <> 6",
)
def a7(spark, sf_dir):
    """Lines as page blocks: every ninth is an image, every seventh has an empty box."""
    n = F.col("n")
    spans = F.transform(F.split("line", ", "), lambda t: F.struct(F.array(F.struct(t.alias("text"), (n % 4 + 10).cast("double").alias("size"), (n % 5 == 0).alias("bold"))).alias("spans")))
    x0, y0 = (n % 3 * 10).cast("double"), (n % 20 * 5).cast("double")
    block = F.struct(F.when(n % 9 == 8, 1).otherwise(0).alias("type"), x0.alias("x0"), y0.alias("y0"), F.when(n % 7 == 6, x0 - 5).otherwise(x0 + 100).alias("x1"), (y0 + 4).alias("y1"), spans.alias("lines"))
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    grouped = lines.groupBy("document_id", (F.floor(n / 20) + 1).cast("int").alias("page_number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda s: s["b"]).alias("blocks"))
    found = records.span_blocks(grouped.withColumn("page_width", F.lit(400.0)).withColumn("page_height", F.lit(100.0)))
    return found.select("document_id", "page_number", "chunk_id", "text", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")), "font_size", "is_bold")


@query(
    "a8_catalogue",
    "SELECT coalesce(d.id, p.id) AS id, d.id IS NOT NULL AS has_document, p.id IS NOT NULL AS has_pdf, coalesce(d.title, p.source_name, CAST(coalesce(d.id, p.id) AS VARCHAR)) AS title"
    " FROM (SELECT doc_id * 2 AS id, CASE WHEN doc_id % 3 = 0 THEN source END AS title FROM documents) d FULL JOIN (SELECT page_id AS id, url AS source_name FROM pages) p ON d.id = p.id",
)
def a8(spark, sf_dir):
    """Documents (with even ids) and files side by side; either may lack the other."""
    docs = documents(spark, sf_dir).select((F.col("doc_id") * 2).alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("title"))
    return records.catalogue(docs, pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("url").alias("source_name")))


@query(
    "a10_editable_overlay",
    f"""WITH {views.BLOCKS}, b AS (SELECT document_id, block_no, block_no AS pos, text, page_number, CASE WHEN block_no % 2 = 0 THEN ['r' || block_no] ELSE [] END AS reps FROM blocks),
    e AS (SELECT document_id, block_no, 1000000 - block_no AS pos, CASE WHEN block_no % 2 = 0 THEN 'edited: ' || text END AS text, CASE WHEN block_no % 7 = 0 THEN 99 END AS page_number FROM b WHERE document_id % 3 <> 0 AND block_no % 5 <> 0
     UNION ALL SELECT document_id, block_no + 100000, 2000000, 'new', NULL FROM b WHERE document_id % 3 <> 0 AND block_no = 1)
    SELECT e.document_id, e.block_no, e.pos, coalesce(e.text, b.text) AS text, coalesce(e.page_number, b.page_number) AS page_number, array_to_string(coalesce(b.reps, []), ',') AS representations FROM e LEFT JOIN b ON b.document_id = e.document_id AND b.block_no = e.block_no
    UNION ALL SELECT document_id, block_no, pos, text, page_number, array_to_string(reps, ',') FROM b WHERE document_id NOT IN (SELECT document_id FROM e)""",
)
def a10(spark, sf_dir):
    """Two thirds of the documents have saved edits: blocks out of order, some dropped, one new, fields left out."""
    base = block_rows(spark, sf_dir).withColumn("pos", F.col("block_no")).withColumn("representations", F.when(F.col("block_no") % 2 == 0, F.array(F.concat(F.lit("r"), F.col("block_no").cast("string")))))
    base = base.select("document_id", "block_no", "pos", "text", "page_number", F.coalesce("representations", none()).alias("representations"))
    edited = base.where("document_id % 3 <> 0")
    changes = edited.where("block_no % 5 <> 0").select("document_id", "block_no", (1_000_000 - F.col("block_no")).alias("pos"), F.when(F.col("block_no") % 2 == 0, F.concat(F.lit("edited: "), "text")).alias("text"), F.when(F.col("block_no") % 7 == 0, 99).alias("page_number"), F.lit(None).cast("array<string>").alias("representations"))
    new = edited.where("block_no = 1").select("document_id", (F.col("block_no") + 100_000).alias("block_no"), F.lit(2_000_000).alias("pos"), F.lit("new").alias("text"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("array<string>").alias("representations"))
    found = records.edited_blocks(base, changes.unionByName(new), ["document_id", "block_no"], ["text", "page_number", "representations"])
    return found.withColumn("representations", F.array_join("representations", ","))


@query("a10_saved_pages", f"WITH {views.CHUNKS}, pc AS (SELECT document_id, page_number, count(*) AS n FROM chunks GROUP BY 1, 2) SELECT document_id, page_number, CASE WHEN document_id % 4 = 0 THEN 0 ELSE n END AS n FROM pc WHERE document_id % 4 <> 0 OR page_number = 1")
def a10_pages(spark, sf_dir):
    base = views.chunks(spark, sf_dir).groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"))
    saved = base.where("document_id % 4 = 0 AND page_number = 1").withColumn("n", F.lit(0).cast("long"))
    return records.replaced_pages(base, saved, "document_id")


@query(
    "a12_key_precedence",
    """WITH s AS (SELECT *, 'set-' || user_id AS qs FROM events), k AS (SELECT qs, 0 AS src, '' AS file, CAST(event_id AS INT) AS pos, 'p' || event_id AS qid, CAST(user_id % 4 AS INT) AS a FROM s WHERE event_type = 'view'
     UNION ALL SELECT qs, 1, printf('%012d', event_id), CAST(n AS INT), CASE WHEN n = 0 THEN qs || '-q1' ELSE 'x' || event_id END, CASE WHEN n = 0 THEN 0 ELSE CAST(event_id % 3 AS INT) END FROM s, range(0, 2) r(n) WHERE event_type = 'click'),
     b AS (SELECT qs, min((src, file)) AS m FROM k GROUP BY 1), w AS (SELECT DISTINCT qs FROM s)
     SELECT w.qs AS question_set_id, k.pos, k.qid AS question_id, k.a AS answer_index, CASE WHEN k.qid IS NULL THEN 'Answer key not found.' END AS error FROM w LEFT JOIN (SELECT k.* FROM k JOIN b ON b.qs = k.qs AND b.m = (k.src, k.file)) k ON k.qs = w.qs""",
)
def a12(spark, sf_dir):
    """Views carry private answers, clicks are exams with two questions (one without an id and an answer), other sets have neither."""
    rows = events(spark, sf_dir).withColumn("question_set_id", F.concat(F.lit("set-"), F.col("user_id").cast("string")))
    private = rows.where("event_type = 'view'").select("question_set_id", F.col("event_id").cast("int").alias("pos"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("question_id"), (F.col("user_id") % 4).cast("int").alias("answer_index"))
    question = lambda i, a: F.struct(i.alias("id"), a.cast("int").alias("answer_index"))
    asked = F.array(question(F.lit(None).cast("string"), F.lit(None)), question(F.concat(F.lit("x"), F.col("event_id").cast("string")), F.col("event_id") % 3))
    exams = rows.where("event_type = 'click'").select(F.format_string("%012d", "event_id").alias("file"), "question_set_id", asked.alias("questions"))
    return elements.answer_rows(private, exams, rows)


@query(
    "a16_export_eligibility",
    "WITH w AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type <> 'error'), f AS (SELECT page_id AS id, max(strlen(html) * 4000) AS n FROM pages GROUP BY 1) SELECT CAST(w.id AS VARCHAR) AS document_id, CASE WHEN f.n IS NULL OR d.doc_id IS NULL THEN 'missing' WHEN f.n > 26214400 THEN 'too large' END AS error FROM w LEFT JOIN f ON f.id = w.id LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'es') d ON d.doc_id = w.id",
)
def a16(spark, sf_dir):
    """Exams by user; Spanish documents are not prepared, page sizes stand for file sizes."""
    exams = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "view", True).alias("enabled"))
    docs = documents(spark, sf_dir).where("lang <> 'es'").select(F.col("doc_id").cast("string").alias("document_id"))
    files = pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("document_id"), (F.octet_length("html") * 4000).cast("long").alias("length"))
    return records.exportable(exams, docs, files)


LAYERS = [(0, "model", "base"), (0, "limits.words", "20"), (0, "limits.chars", "6000"), (0, "title", "t")]


@query(
    "a17_layered_config",
    """WITH o AS (SELECT user_id AS id, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS layer, CASE event_id % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'limits.words' WHEN 2 THEN 'limits' WHEN 3 THEN 'title.short' ELSE 'extra.' || event_type END AS path, arg_max('v' || event_id, event_id) AS value FROM events GROUP BY 1, 2, 3),
     a AS (SELECT * FROM o UNION ALL SELECT id, layer, path, value FROM (SELECT DISTINCT user_id AS id FROM events), (VALUES (0, 'model', 'base'), (0, 'limits.words', '20'), (0, 'limits.chars', '6000'), (0, 'title', 't')) d(layer, path, value))
     SELECT id AS document_id, path, value FROM a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.id = a.id AND b.layer > a.layer AND (b.path = a.path OR b.path LIKE a.path || '.%' OR a.path LIKE b.path || '.%'))""",
)
def a17(spark, sf_dir):
    """Defaults for all, two layers of overrides by user; some replace a branch by a leaf or a leaf by a branch."""
    n = F.col("event_id")
    path = F.when(n % 5 == 0, "model").when(n % 5 == 1, "limits.words").when(n % 5 == 2, "limits").when(n % 5 == 3, "title.short").otherwise(F.concat(F.lit("extra."), "event_type"))
    rows = events(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("layer"), path.alias("path"), "event_id")
    own = rows.groupBy("document_id", "layer", "path").agg(F.concat(F.lit("v"), F.max("event_id").cast("string")).alias("value"))
    common = spark.createDataFrame([(None, *row) for row in LAYERS], own.schema)
    return settings.layered(rows.select("document_id").distinct(), own.unionByName(common))


ITEMS = f"""it AS (SELECT document_id, reading_order // 3 AS item_no, page_number, min(x * 600) AS x0, min(y * 800) AS y0, max(x * 600 + 240) AS x1, max(y * 800 + 12) AS y1, CASE WHEN reading_order // 3 % 11 = 10 THEN ' ' ELSE 'item ' || reading_order // 3 END AS text FROM chunks GROUP BY ALL)"""


@query(
    "a18_multi_page_items",
    f"WITH {views.CHUNKS}, {ITEMS} SELECT document_id, page_number, format('item-{{:03d}}-{{:04d}}', page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY item_no)) AS chunk_id, text, round(x0 / 600, 6) AS x, round(least(greatest(1 - y1 / 800, 0), 1), 6) AS y, round(least((x1 - x0) / 600, 1), 6) AS width, round(least((y1 - y0) / 800, 1), 6) AS height FROM it WHERE trim(text) <> ''",
)
def a18(spark, sf_dir):
    """Three neighbouring chunks are an item, wherever they stand; every eleventh item is blank."""
    chunks = views.written_chunks(spark, sf_dir).withColumn("item_no", F.floor(F.col("reading_order") / 3))
    x0, y0 = F.col("x") * 600, F.col("y") * 800
    prov = F.struct("page_number", x0.alias("x0"), y0.alias("y0"), (x0 + 240).alias("x1"), (y0 + 12).alias("y1"))
    items = chunks.groupBy("document_id", "item_no").agg(F.collect_list(prov).alias("prov"))
    items = items.withColumn("text", F.when(F.col("item_no") % 11 == 10, " ").otherwise(F.concat(F.lit(" item\n"), F.col("item_no").cast("string"))))
    sizes = chunks.select("document_id", "page_number").distinct().withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(800.0))
    found = records.page_items(items, sizes)
    return found.select("document_id", "page_number", "chunk_id", "text", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")))


@query(
    "a19_source_discovery",
    "WITH f AS (SELECT source AS id, CASE WHEN lang = 'en' AND doc_id % 7 = 0 AND length(source) > 4 THEN 'source.pdf' WHEN doc_id % 3 = 0 THEN 'notes.txt' ELSE doc_id || '.pdf' END AS file FROM documents) SELECT id AS document_id, coalesce(min(file) FILTER (file = 'source.pdf'), min(file)) AS file FROM f WHERE file LIKE '%.pdf' GROUP BY 1",
)
def a19(spark, sf_dir):
    """Documents as files in their source's folder; some folders have a source.pdf, every third file is none."""
    n = F.col("doc_id")
    name = F.when((F.col("lang") == "en") & (n % 7 == 0) & (F.length("source") > 4), "source.pdf").when(n % 3 == 0, "notes.txt").otherwise(F.concat(n.cast("string"), F.lit(".pdf")))
    return records.sources(documents(spark, sf_dir).select(F.concat(F.lit("/pdf/"), "source", F.lit("/"), name).alias("path")))


TEXTS = "CASE event_id % 12 WHEN 0 THEN '12' WHEN 1 THEN ' 7 ' WHEN 2 THEN '1.9' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN '1e3' WHEN 7 THEN '[1,\"a\"]' WHEN 8 THEN '{\"a\":1}' WHEN 9 THEN '-3' WHEN 10 THEN concat('', event_id % 1000) ELSE props END"


@query(
    "b5_tolerant_casts",
    f"WITH v AS (SELECT event_id, {TEXTS} AS v FROM events) SELECT event_id, CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(v) AS INT) END AS i, CASE WHEN regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(v) AS DOUBLE) END AS d, CASE WHEN v LIKE '[%' THEN '1|\"a\"' ELSE '' END AS items FROM v",
)
def b5(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", f"{TEXTS} AS v")
    return rows.select("event_id", tx.to_int(F.col("v")).alias("i"), tx.to_double(F.col("v")).alias("d"), F.array_join(records.list_or_empty(F.col("v")), "|").alias("items"))


@query("b6_bold", f"WITH {views.CHUNKS} SELECT document_id, page_number, bool_or(reading_order % 6 = 0 OR reading_order % 4 IN (0, 3)) AS named, bool_or(CASE WHEN reading_order % 5 > 0 THEN is_bold END) AS spans FROM chunks GROUP BY 1, 2")
def b6(spark, sf_dir):
    """By type and font name, and by the spans; every fifth chunk has no span."""
    n = F.col("reading_order")
    font = F.when(n % 4 == 0, "Arial-BOLD").when(n % 4 == 1, "Times").when(n % 4 == 3, "SemiBold")
    spans = F.when(n % 5 > 0, F.array(F.struct(F.lit(None).cast("boolean").alias("bold")), F.struct(F.col("is_bold").alias("bold")))).otherwise(F.array().cast("array<struct<bold:boolean>>"))
    rows = views.chunks(spark, sf_dir).select("document_id", "page_number", records.named_bold(F.when(n % 6 == 0, "heading"), font).alias("named"), records.bold(spans).alias("spans"))
    return rows.groupBy("document_id", "page_number").agg(F.bool_or("named").alias("named"), F.bool_or("spans").alias("spans"))


@query(
    "b11_definitions",
    """WITH d AS (SELECT user_id AS id, event_id AS pos, CASE event_id % 4 WHEN 0 THEN event_type || ' x' WHEN 1 THEN upper(event_type) WHEN 2 THEN 'representation' ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id ELSE 'Summarise the text.' END AS prompt, CASE WHEN event_id % 5 = 0 THEN '#fff' ELSE '#263238' END AS background, CASE event_id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE 1 END::DOUBLE AS opacity, event_id % 7 <> 0 AS enabled FROM events)
     SELECT id, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(prompt, pos) AS prompt, arg_min(background, pos) AS background, arg_min(opacity, pos) AS opacity, arg_min(enabled, pos) AS enabled FROM d GROUP BY id, lower(name)
     UNION ALL SELECT doc_id, pos, name, 'Summarise the text.', '#263238', 1.0, true FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM d)), (VALUES (0, 'keywords'), (1, 'summary')) v(pos, name)""",
)
def b11(spark, sf_dir):
    """Users' definitions with gaps and repeated names; documents without a user of that id have none."""
    n, kind = F.col("event_id"), F.col("event_type")
    name = F.when(n % 4 == 0, F.concat(F.lit("  "), kind, F.lit(" \n x "))).when(n % 4 == 1, F.upper(kind)).when(n % 4 == 2, " ").otherwise(kind)
    opacity = F.when(n % 6 == 0, "0.5").when(n % 6 == 1, "-2").when(n % 6 == 2, "7").when(n % 6 == 3, "much")
    rows = events(spark, sf_dir).select(F.col("user_id").alias("id"), n.alias("pos"), name.alias("name"), F.when(n % 3 == 0, F.concat(F.lit(" p"), n.cast("string"))).when(n % 3 == 1, " ").alias("prompt"), F.when(n % 5 == 0, "#fff").alias("background"), opacity.alias("opacity"), F.when(n % 7 == 0, False).when(n % 7 == 1, True).alias("enabled"))
    owners = documents(spark, sf_dir).select(F.col("doc_id").alias("id")).unionByName(rows.select("id"))
    return settings.definitions(owners, rows, "id")


def _bounded_sql(name):
    low, high, default = settings.BOUNDS[name]
    kind = "INT" if isinstance(low, int) else "DOUBLE"
    parsed = "i" if kind == "INT" else "d"
    value = f"greatest(coalesce({parsed}, {default}), {low})"
    return f"CAST({value if high is None else f'least({value}, {high})'} AS {kind}) AS {name}"


@query(
    "b14_bounded_config",
    f"WITH v AS (SELECT event_id, trim({TEXTS}) AS v FROM events), p AS (SELECT event_id, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN TRY_CAST(v AS INT) END AS i, CASE WHEN regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(v AS DOUBLE) END AS d FROM v) SELECT event_id, {', '.join(map(_bounded_sql, settings.BOUNDS))} FROM p",
)
def b14(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", f"{TEXTS} AS v")
    return rows.select("event_id", *(settings.bounded(name, F.col("v")).alias(name) for name in settings.BOUNDS))


@query(
    "b15_request_text",
    f"WITH {views.BLOCKS}, n AS (SELECT *, {WORDS} AS words FROM blocks) SELECT document_id, block_no, CASE block_no % 4 WHEN 0 THEN format('Return JSON {{{{\"k\": [...]}}}} with up to 5 key phrases of: {{}}', text) WHEN 1 THEN format('Return JSON {{{{\"s\": \"...\"}}}} of about {{}} words on: {{}}', greatest(8, CAST(ceil(words * CAST(0.15 AS DOUBLE)) AS INT)), text) WHEN 2 THEN 'Name the tone. Return JSON {{\"v\": \"...\"}} for: '.replace('{{', '{{').replace('}}', '}}') || text ELSE 'Describe the text. Return JSON {{\"v\": \"...\"}} for: ' || text END AS request FROM n".replace("'.replace('{{', '{{').replace('}}', '}}')", "'").replace('Return JSON {{"v"', 'Return JSON {"v"').replace('"..."}} for', '"..."} for'),
)
def b15(spark, sf_dir):
    target = tx.target_words(tx.word_count(F.col("text")), 0.15)
    kind = F.when(F.col("block_no") % 4 == 0, "keywords").when(F.col("block_no") % 4 == 1, "summary").otherwise("tone")
    instruction = F.when(F.col("block_no") % 4 == 2, " Name the tone.").otherwise(" ")
    return block_rows(spark, sf_dir).select("document_id", "block_no", features.request_text(kind, F.col("text"), target, 5, instruction).alias("request"))


@query(
    "b22_selection_summary",
    f"""WITH {views.BLOCKS}, s AS (SELECT document_id, block_no // 3 AS sel, chunk_id, reading_order, page_number FROM c3), g AS (SELECT document_id, sel, list(chunk_id ORDER BY reading_order DESC) AS ids, list(page_number ORDER BY reading_order) AS ps FROM s GROUP BY 1, 2),
    sl AS (SELECT *, list_filter(ps, lambda x, i: i = 1 OR x <> ps[i - 1]) AS pages, CASE WHEN sel % 4 = 0 THEN list_concat(ids, ['zz']) ELSE ids END AS all_ids FROM g)
    SELECT document_id, sel AS selection_id, CASE WHEN sel % 5 = 0 THEN 'No chunks selected.' ELSE len(all_ids) || ' selected on p' || array_to_string(pages, ', p') || ': ' || array_to_string(all_ids[1:4], ', ') || CASE WHEN len(all_ids) > 4 THEN ', +' || (len(all_ids) - 4) || ' more' ELSE '' END END AS summary FROM sl""",
)
def b22(spark, sf_dir):
    """Three blocks are a selection, its ids backwards; every fourth has an unknown id, every fifth is empty."""
    chunks = views.written_chunks(spark, sf_dir)
    groups = layout.reading_blocks(chunks).withColumn("selection_id", F.floor(F.col("block_no") / 3)).groupBy("document_id", "selection_id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id"))), lambda s: s["chunk_id"])).alias("ids"))
    more = F.when(F.col("selection_id") % 4 == 0, F.array(F.lit("zz"))).otherwise(none())
    return layout.selection_summaries(groups.select("document_id", "selection_id", F.when(F.col("selection_id") % 5 == 0, none()).otherwise(F.concat("ids", more)).alias("chunk_ids")), chunks)


@query("c4_heading_chunk", f"WITH {views.CHUNKS}, f AS (SELECT document_id, coalesce(median(font_size), 12) AS body FROM chunks GROUP BY 1) SELECT document_id, reading_order, CASE WHEN reading_order % 19 = 0 THEN true ELSE regexp_matches(trim(text), '^(\\d+(\\.\\d+)*|[IVXLC]+|[A-Z])[.)]?\\s+\\S') OR (({C} <> '' AND length({C}) <= 140 AND len(string_split({C}, ' ')) <= 14 AND NOT regexp_matches({C}, '[.?!]$')) AND (is_bold OR coalesce(font_size, 0) >= body * 1.12)) END AS heading FROM chunks JOIN f USING (document_id)")
def c4(spark, sf_dir):
    rows = layout.with_body_font(views.chunks(spark, sf_dir))
    typed = F.when(F.col("reading_order") % 19 == 0, "heading")
    return rows.select("document_id", "reading_order", tx.heading_chunk(F.col("text"), typed, F.col("is_bold"), F.col("font_size"), F.col("body_font")).alias("heading"))


@query("c8_visibility", "SELECT event_id, CASE event_id % 3 WHEN 1 THEN event_type IN ('view', 'click') OR user_id % 4 = 0 ELSE false END AS enabled, NOT (event_id % 4 > 0 AND event_type = 'view') AS shown FROM events")
def c8(spark, sf_dir):
    """By the condition's list (names and kinds; empty, or none), and by the reader's flags (false for one kind, true for another, or none)."""
    n = F.col("event_id")
    listed = F.when(n % 3 == 1, F.array(F.lit("view"), F.lit("click"), F.lit("name 0"))).when(n % 3 == 2, none())
    name = F.concat(F.lit("name "), (F.col("user_id") % 4).cast("string"))
    flags = F.when(n % 4 > 0, F.create_map(F.lit("view"), F.lit(False), F.lit("click"), F.lit(True)))
    return events(spark, sf_dir).select("event_id", settings.enabled_by(name, F.col("event_type"), listed).alias("enabled"), settings.reader_shows(F.col("event_type"), flags).alias("shown"))


# ---- layout

COLUMNS = """cc AS (SELECT document_id, page_number, reading_order, x, x + width AS r, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y, x, reading_order) AS n FROM chunks)"""


@query(
    "d4_columns",
    f"""WITH RECURSIVE {views.CHUNKS}, {COLUMNS},
     f AS (SELECT document_id, page_number, reading_order, n, [x] AS ls, [r] AS rs, 1 AS k FROM cc WHERE n = 1
      UNION ALL SELECT document_id, page_number, reading_order, n, CASE WHEN k > len(ls) THEN list_append(ls, x) ELSE list_transform(ls, lambda v, i: CASE WHEN i = k THEN least(v, x) ELSE v END) END, CASE WHEN k > len(rs) THEN list_append(rs, r) ELSE list_transform(rs, lambda v, i: CASE WHEN i = k THEN greatest(v, r) ELSE v END) END, k
      FROM (SELECT c.*, f.ls, f.rs, coalesce(list_position(list_transform(f.ls, lambda v, i: greatest(0, least(f.rs[i], c.r) - greatest(v, c.x)) / greatest(least(f.rs[i] - v, c.r - c.x), 1e-6) >= 0.35 OR abs((v + f.rs[i]) / 2 - (c.x + c.r) / 2) <= 0.08 OR abs(v - c.x) <= 0.05), true), len(f.ls) + 1) AS k FROM f JOIN cc c ON c.document_id = f.document_id AND c.page_number = f.page_number AND c.n = f.n + 1)),
     last AS (SELECT document_id, page_number, arg_max(ls, n) AS ls FROM f GROUP BY 1, 2)
     SELECT f.document_id, f.page_number, f.reading_order, CAST(len(list_filter(last.ls, lambda v, i: v < last.ls[f.k] OR (v = last.ls[f.k] AND i < f.k))) AS INT) AS column_no FROM f JOIN last USING (document_id, page_number)""",
)
def d4(spark, sf_dir):
    return layout.columns_of_page(views.chunks(spark, sf_dir)).select("document_id", "page_number", "reading_order", "column_no")


@query("d5_layout_paragraphs")
def d5(spark, sf_dir):
    chunks = layout.columns_of_page(layout.with_body_font(views.chunks(spark, sf_dir)))
    return layout.merge_paragraphs(chunks).select("document_id", "page_number", "column_no", "reading_order", "paragraph_no")


TITLED = (
    ASSEMBLED
    + """,
mt AS (SELECT *, 'source.pdf' AS src, CASE document_id % 4 WHEN 1 THEN ' ' WHEN 2 THEN 'source.pdf' WHEN 3 THEN 'Meta ' || document_id END AS meta, page_number = 1 AND y <= 0.30 AND length(text) <= 220 AND NOT regexp_matches(trim(text), '^(\\d+(\\.\\d+)*|[IVXLC]+|[A-Z])[.)]?\\s+\\S') AS near FROM roled),
cand AS (SELECT document_id, block_no, text, font_size, body, row_number() OVER o AS rank, lead(font_size) OVER o AS nxt FROM mt WHERE near WINDOW o AS (PARTITION BY document_id ORDER BY font_size DESC, y, block_no)),
best AS (SELECT document_id, block_no, text FROM cand WHERE rank = 1 AND font_size >= greatest(body * 1.2, coalesce(nxt, 0) + 1.5) AND document_id % 4 <> 3),
titled AS (SELECT mt.*, CASE WHEN mt.document_id % 4 = 3 THEN meta ELSE coalesce(best.text, src) END AS title FROM mt LEFT JOIN best USING (document_id) WHERE best.block_no IS NULL OR best.block_no <> mt.block_no)
"""
)


def titled(spark, sf_dir):
    """Every fourth document has a title of its own, one a blank one, one its file's name."""
    n = F.col("document_id")
    meta = F.when(n % 4 == 1, " ").when(n % 4 == 2, "source.pdf").when(n % 4 == 3, F.concat(F.lit("Meta "), n.cast("string")))
    return layout.titled(roled(spark, sf_dir).withColumn("source_name", F.lit("source.pdf")).withColumn("metadata_title", meta), "block_no")


@query("d7_title", f"WITH {TITLED} SELECT document_id, block_no, title FROM titled")
def d7(spark, sf_dir):
    return titled(spark, sf_dir).select("document_id", "block_no", "title")


SHORT = "CASE WHEN length(c) <= 56 THEN c ELSE rtrim(substr(c, 1, 53)) || '...' END"
OUTLINE = """
o1 AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, count(*) FILTER (role = 'section') OVER w AS sno, arg_min(role, block_no) OVER (PARTITION BY document_id) <> 'section' AS def FROM titled WINDOW w AS (PARTITION BY document_id ORDER BY block_no)),
o2 AS (SELECT *, sno + CASE WHEN def THEN 1 ELSE 0 END AS sec FROM o1),
o3 AS (SELECT *, count(*) FILTER (role = 'subsection') OVER (PARTITION BY document_id, sec ORDER BY block_no) AS subs FROM o2),
o4 AS (SELECT *, count(*) FILTER (role = 'subsection' OR (role = 'paragraph' AND subs = 0)) OVER (PARTITION BY document_id, sec ORDER BY block_no) AS direct, row_number() OVER (PARTITION BY document_id, sec, subs ORDER BY block_no) - 1 AS below, CASE WHEN role = 'paragraph' THEN format('block-{:03d}-{:04d}', page_number, row_number() OVER (PARTITION BY document_id, page_number, role = 'paragraph' ORDER BY block_no)) END AS block_id FROM o3),
o5 AS (SELECT *, format('section-{:03d}', sec) AS sid, max(CASE WHEN role = 'subsection' THEN direct END) OVER (PARTITION BY document_id, sec, subs) AS sub FROM o4),
nodes AS (SELECT document_id, CASE role WHEN 'section' THEN sid WHEN 'subsection' THEN sid || format('-subsection-{:03d}', direct) ELSE 'node-' || block_id END AS node_id, CASE WHEN role = 'section' THEN 'document-root' WHEN role = 'subsection' OR subs = 0 THEN sid ELSE sid || format('-subsection-{:03d}', sub) END AS parent_id, CASE WHEN role = 'section' THEN sec WHEN role = 'subsection' OR subs = 0 THEN direct ELSE below END AS ordinal, CASE WHEN role = 'section' THEN 1 WHEN role = 'subsection' OR subs = 0 THEN 2 ELSE 3 END AS level, role AS node_type, CASE WHEN role = 'paragraph' THEN CASE WHEN length(c) <= 56 THEN c ELSE rtrim(substr(c, 1, 53)) || '...' END ELSE text END AS title, page_number, block_id FROM o5
 UNION ALL SELECT DISTINCT document_id, 'document-root', NULL, 1, 0, 'document', title, NULL::INT, NULL FROM titled
 UNION ALL SELECT DISTINCT document_id, 'section-001', 'document-root', 1, 1, 'section', 'Body', NULL::INT, NULL FROM o1 WHERE def)
"""


@query("d11_outline", f"WITH {TITLED}, {OUTLINE} SELECT * FROM nodes")
def d11(spark, sf_dir):
    return layout.outline(titled(spark, sf_dir), "block_no")


@query(
    "d13_grouped_blocks",
    f"""WITH {views.BLOCKS} SELECT document_id, block_no AS group_no, CASE WHEN block_no % 4 = 1 THEN 'p-' || block_no ELSE format('block-{{:03d}}-{{:04d}}', page_number, block_no) END AS block_id, page_number, CASE WHEN block_no % 3 = 1 THEN 'A/ B' ELSE 'Body' END AS path, array_to_string(list_reverse(list_filter(string_split(coalesce(ts, ''), chr(1)), lambda x: x <> '')), ' ') AS text, array_to_string(list_reverse(chunk_ids), ',') AS chunk_ids
     FROM blocks JOIN (SELECT document_id, block_no, string_agg(trim(text), chr(1) ORDER BY reading_order) AS ts FROM c3 GROUP BY 1, 2) USING (document_id, block_no) WHERE block_no % 6 <> 0""",
)
def d13(spark, sf_dir):
    """Groups with unknown ids, some with no other; blank and missing paths and names."""
    chunks = views.written_chunks(spark, sf_dir)
    n = F.col("block_no")
    name = F.when(n % 4 == 1, F.concat(F.lit("-p "), n.cast("string"))).when(n % 4 == 2, "  ").when(n % 4 == 3, "--")
    path = F.when(n % 3 == 0, F.array(F.lit(" "), F.lit(""))).when(n % 3 == 1, F.array(F.lit("A"), F.lit(""), F.lit(" B")))
    ids = F.when(n % 6 == 0, F.array(F.lit("zz"))).otherwise(F.concat(F.array(F.lit("zz")), F.reverse("chunk_ids")))
    groups = blocks_of(chunks).select("document_id", n.alias("group_no"), name.alias("paragraph_id"), path.alias("section_path"), ids.alias("chunk_ids"))
    found = layout.grouped_blocks(groups, chunks)
    return found.select("document_id", "group_no", "block_id", "page_number", F.array_join("section_path", "/").alias("path"), "text", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("d14_chunk_blocks", f"WITH {views.BLOCKS} SELECT c3.document_id, chunk_id, CASE WHEN {WORDS.replace('text', 'blocks.text')} > 20 THEN 'b' || CAST(c3.block_no AS INT) || CASE WHEN c3.block_no % 5 = 0 THEN ',x' || CAST(c3.block_no AS INT) ELSE '' END ELSE '' END AS block_ids FROM c3 JOIN blocks ON blocks.document_id = c3.document_id AND blocks.block_no = c3.block_no")
def d14(spark, sf_dir):
    """Blocks too short for any job are dropped, every fifth stands twice under two names."""
    chunks = views.written_chunks(spark, sf_dir)
    long = blocks_of(chunks).where(tx.word_count(F.col("text")) > 20)
    named = long.select("document_id", (F.col("block_no") * 2).alias("at"), F.concat(F.lit("b"), F.col("block_no").cast("string")).alias("block_id"), "chunk_ids")
    again = long.where("block_no % 5 = 0").select("document_id", (F.col("block_no") * 2 + 1).alias("at"), F.concat(F.lit("x"), F.col("block_no").cast("string")).alias("block_id"), "chunk_ids")
    return layout.chunk_blocks(chunks, named.unionByName(again), "at").select("document_id", "chunk_id", F.array_join("block_ids", ",").alias("block_ids"))


def saved_blocks(blocks):
    """Blocks as saved: ids and pages left out or wrong, blank chunk ids, some without any."""
    n = F.col("block_no")
    ids = F.when(n % 7 == 0, none()).when(n % 5 == 0, F.concat(F.array(F.lit(" ")), "chunk_ids")).otherwise(F.col("chunk_ids"))
    page = F.when(n % 4 == 0, F.concat(F.lit(" "), F.col("page_number").cast("string"))).when(n % 4 == 1, "x")
    return blocks.select("document_id", n.alias("pos"), F.when(n % 3 == 1, "").when(n % 3 == 2, F.concat(F.lit("b"), n.cast("string"), F.lit(" "))).alias("block_id"), page.alias("page_number"), ids.alias("chunk_ids"), F.when(n % 2 == 0, F.col("text")).alias("text"))


@query(
    "d16_document_normalise",
    f"WITH {views.BLOCKS} SELECT document_id, block_no AS pos, CASE WHEN block_no % 3 = 2 THEN 'b' || block_no ELSE format('paragraph-{{:04d}}', block_no) END AS block_id, CASE WHEN block_no % 4 = 0 OR block_no % 7 <> 0 THEN page_number ELSE 1 END AS page_number, CASE WHEN block_no % 7 = 0 THEN '' ELSE array_to_string(chunk_ids, ',') END AS chunk_ids, CASE WHEN block_no % 2 = 0 THEN text ELSE '' END AS text FROM blocks",
)
def d16(spark, sf_dir):
    chunks = views.written_chunks(spark, sf_dir)
    return layout.normalised_blocks(saved_blocks(blocks_of(chunks)), chunks).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("d16_page_counts", f"WITH {views.BLOCKS}, pc AS (SELECT document_id, count(DISTINCT page_number) AS n FROM chunks GROUP BY 1), b AS (SELECT document_id, count(*) AS n FROM blocks GROUP BY 1) SELECT doc_id AS document_id, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE coalesce(pc.n, 0) END AS INT) AS page_count, coalesce(b.n, 0) AS paragraph_count FROM documents LEFT JOIN pc ON pc.document_id = doc_id LEFT JOIN b ON b.document_id = doc_id")
def d16_pages(spark, sf_dir):
    chunks = views.written_chunks(spark, sf_dir)
    count = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "many")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), count.alias("page_count"))
    return layout.normalised_documents(docs, chunks, blocks_of(chunks))


@query("d17_renumber", f"WITH {views.BLOCKS} SELECT document_id, 'paragraph-' || row_number() OVER (PARTITION BY document_id ORDER BY block_no) AS block_id, text FROM blocks QUALIFY {WORDS} >= 5")
def d17(spark, sf_dir):
    """Entries of fewer than five words are no blocks, but count."""
    entry = F.when(tx.word_count(F.col("text")) >= 5, F.struct("text"))
    listed = block_rows(spark, sf_dir).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", entry.alias("e")))), lambda s: s["e"]).alias("blocks"))
    return listed.select("document_id", F.explode(layout.placed_ids(F.col("blocks"))).alias("p")).select("document_id", "p.block_id", "p.block.text")


@query(
    "d18_rematch",
    f"""WITH {views.BLOCKS}, s AS (SELECT document_id, block_no, list_concat(chunk_ids[2:], ['c' || (CAST(substr(chunk_ids[len(chunk_ids)], 2) AS INT) + 1)]) AS ids FROM blocks WHERE block_no % 4 <> 0), u AS (SELECT document_id, block_no, unnest(ids) AS chunk_id FROM s),
    k AS (SELECT u.document_id, u.block_no, arg_min(c.page_number, c.reading_order) AS page_number, string_agg(c.text, chr(10) || chr(10) ORDER BY c.reading_order) AS text, string_agg(c.chunk_id, ',' ORDER BY c.reading_order) AS ids FROM u JOIN chunks c USING (document_id, chunk_id) GROUP BY 1, 2)
    SELECT b.document_id, 'b' || b.block_no AS block_id, coalesce(k.page_number, CASE WHEN b.block_no % 8 = 0 THEN 1 ELSE b.page_number END) AS page_number, coalesce(nullif(k.text, ''), b.text) AS text, coalesce(k.ids, '') AS chunk_ids FROM blocks b LEFT JOIN k USING (document_id, block_no)""",
)
def d18(spark, sf_dir):
    """In every block the first chunk is given up for the one that follows the last, named twice and first; every fourth gives up all."""
    chunks = views.chunks(spark, sf_dir)
    n = F.col("block_no")
    after = F.concat(F.lit("c"), (F.substring(F.element_at("chunk_ids", -1), 2, 20).cast("int") + 1).cast("string"))
    ids = F.when(n % 4 == 0, F.array(F.lit("zz"))).otherwise(F.concat(F.array(after, F.lit("zz"), after), F.reverse(F.slice("chunk_ids", 2, 100_000))))
    blocks = blocks_of(chunks).select("document_id", F.concat(F.lit("b"), n.cast("string")).alias("block_id"), F.when(n % 8 != 0, F.col("page_number")).alias("page_number"), "text", ids.alias("chunk_ids"))
    return layout.rematched(blocks, chunks).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


#: Characters of text that one task aligns: a chunk becomes dozens of candidates.
ALIGNED_CHARS = 4_000_000


def units(blocks):
    """Body units: the blocks' texts without their longest words, so that coverage varies; every ninth document's are written backwards and found nowhere."""
    text = F.array_join(F.filter(F.split("text", " "), lambda w: F.length(w) < 14), " ")
    text = F.when(F.col("document_id") % 9 == 8, F.reverse(text)).otherwise(text)
    return blocks.select("document_id", F.col("block_no").alias("unit_no"), text.alias("text"))


#: All starts of all units: the eight chunks from each, near or not, and the run among them.
NEAR = f"""tk AS (SELECT document_id, reading_order, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS own FROM chunks),
 un AS (SELECT document_id, block_no AS unit_no, list_distinct(regexp_extract_all(lower(CASE WHEN document_id % 9 = 8 THEN reverse(kept) ELSE kept END), '[a-z0-9]+')) AS unit FROM (SELECT *, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) < 14), ' ') AS kept FROM blocks)),
 hits AS (SELECT un.document_id, un.unit_no, len(unit) AS m, reading_order AS k, list_intersect(own, unit) AS hit FROM un JOIN tk USING (document_id) WHERE len(unit) > 0 AND len(own) > 0 AND len(list_intersect(own, unit)) / len(own) >= 0.45),
 st AS (SELECT DISTINCT h.document_id, h.unit_no, h.m, t.reading_order AS start FROM hits h JOIN tk t ON t.document_id = h.document_id AND h.k BETWEEN t.reading_order AND t.reading_order + 7),
 wn AS (SELECT st.*, t.reading_order AS k, h.hit FROM st JOIN tk t ON t.document_id = st.document_id AND t.reading_order BETWEEN st.start AND st.start + 7 LEFT JOIN hits h ON h.document_id = st.document_id AND h.unit_no = st.unit_no AND h.k = t.reading_order WHERE len(t.own) > 0),
 fh AS (SELECT *, min(k) FILTER (hit IS NOT NULL) OVER (PARTITION BY document_id, unit_no, start) AS first FROM wn),
 mi AS (SELECT *, min(k) FILTER (hit IS NULL AND k > first) OVER (PARTITION BY document_id, unit_no, start) AS miss FROM fh),
 rn AS (SELECT *, len(list_distinct(flatten(list(hit) OVER (PARTITION BY document_id, unit_no, start ORDER BY k)))) / m AS c FROM mi WHERE hit IS NOT NULL AND k < coalesce(miss, 1000000000)),
 en AS (SELECT *, min(k) FILTER (c >= 0.8) OVER (PARTITION BY document_id, unit_no, start) AS enough FROM rn),
 cand AS (SELECT document_id, unit_no, start, string_agg(k, ',' ORDER BY k) AS chunks, max(k) AS stop, max(c) AS coverage FROM en WHERE k <= coalesce(enough, 1000000000) GROUP BY ALL)"""


@query("d20_alignment_runs", f"WITH {views.BLOCKS}, {NEAR} SELECT document_id, unit_no, start, chunks, coverage FROM cand")
def d20(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir, ALIGNED_CHARS)
    return alignment.runs(units(blocks_of(chunks)), chunks).withColumn("chunks", F.array_join("chunks", ","))


#: The greedy choice, one unit of every document a round; candidates of a unit that has none end no document.
ALIGNED = f"""WITH RECURSIVE {views.BLOCKS.strip()}, {NEAR},
 us AS (SELECT document_id, unit_no, row_number() OVER (PARTITION BY document_id ORDER BY unit_no) AS n, list({{'start': start, 'stop': stop, 'coverage': coverage, 'chunks': chunks}} ORDER BY start) AS runs FROM cand GROUP BY 1, 2),
 al AS (SELECT document_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS unit_no, CAST(-1 AS INT) AS cursor, CAST(NULL AS INT) AS start, CAST(NULL AS VARCHAR) AS chunks FROM us GROUP BY 1
  UNION ALL SELECT document_id, n, unit_no, coalesce(p.stop, cursor), p.start, p.chunks FROM (
   SELECT u.document_id, u.n, u.unit_no, al.cursor, coalesce(list_filter(own, lambda r: r.coverage >= 0.8)[1], list_filter(own, lambda r: r.coverage >= 0.45 AND r.coverage = list_max(list_transform(own, lambda x: x.coverage)))[1]) AS p
   FROM al JOIN (SELECT * FROM us) u ON u.document_id = al.document_id AND u.n = al.n + 1, LATERAL (SELECT list_filter(u.runs, lambda r: r.start > al.cursor) AS own)))"""


@query("d21_aligned_chunks", f"{ALIGNED} SELECT document_id, unit_no, start, chunks FROM al WHERE chunks IS NOT NULL")
def d21(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir, ALIGNED_CHARS)
    return alignment.align(units(blocks_of(chunks)), chunks).withColumn("chunks", F.array_join("chunks", ","))


@query(
    "d22_body_filter",
    f"""{ALIGNED}, sel AS (SELECT document_id, CAST(unnest(string_split(chunks, ',')) AS INT) AS reading_order FROM al WHERE chunks IS NOT NULL),
    ok AS (SELECT document_id, count(*) > 0 AS found FROM sel GROUP BY 1)
    SELECT c.document_id, c.page_number, coalesce(string_agg(c.chunk_id, ',' ORDER BY c.reading_order) FILTER (sel.reading_order IS NOT NULL), '') AS chunk_ids, CASE WHEN ok.found IS NULL THEN 'nothing of the body was found' END AS error
    FROM chunks c LEFT JOIN sel ON sel.document_id = c.document_id AND sel.reading_order = c.reading_order LEFT JOIN ok ON ok.document_id = c.document_id GROUP BY ALL""",
)
def d22(spark, sf_dir):
    """The chunks that body units align with, page by page; every ninth document has none."""
    chunks = views.chunks(spark, sf_dir, ALIGNED_CHARS)
    wanted = units(blocks_of(chunks))
    # rows that come out of Python are no longer known to be dealt by document
    selected = alignment.selected_chunks(alignment.align(wanted, chunks)).repartition(views.parts(spark, sf_dir, ALIGNED_CHARS), "document_id")
    return layout.body_only(chunks, selected).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


# ---- windows


def _halved(rounds=4, most=450):
    """SQL of the rounds: h<k> halves the parts of h<k - 1> whose characters exceed the limit."""
    parts = ["h0 AS (SELECT document_id, reading_order, window_no, n_chars, '' AS part FROM win)"]
    for k in range(1, rounds + 1):
        parts.append(f"h{k} AS (SELECT document_id, reading_order, window_no, n_chars, CASE WHEN sum(n_chars) OVER g > {most} AND count(*) OVER g > 1 THEN part || CASE WHEN row_number() OVER (PARTITION BY document_id, window_no, part ORDER BY reading_order) <= greatest(1, count(*) OVER g // 2) THEN '0' ELSE '1' END ELSE part END AS part FROM h{k - 1} WINDOW g AS (PARTITION BY document_id, window_no, part))")
    parts.append(f"halved AS (SELECT *, sum(n_chars) OVER (PARTITION BY document_id, window_no, part) > {most} AS failed FROM h{rounds})")
    return ", ".join(parts)


def overflowed(chunks):
    """Windows whose output a model cuts off above 450 characters of input."""
    return windows.split_overflow(windows.pack_windows(chunks), lambda chars, size: chars > 450)


@query("e4_halve", f"WITH {PACKED}, {_halved()} SELECT document_id, reading_order, window_no, part, failed FROM halved")
def e4(spark, sf_dir):
    return overflowed(views.chunks(spark, sf_dir)).select("document_id", "reading_order", "window_no", "part", "failed")


@query("a20_window_artefacts", f"WITH {PACKED}, {_halved()}, ar AS (SELECT document_id, window_no, part, string_agg('c' || reading_order, ',' ORDER BY reading_order) AS chunk_ids, CAST(sum(n_chars) AS BIGINT) AS chars, bool_or(failed) AS failed FROM halved GROUP BY 1, 2, 3) SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY window_no, part) AS INT) AS artefact_no, window_no, part, chunk_ids, chars, failed FROM ar")
def a20(spark, sf_dir):
    """What each window or part of one was given, written to a table and read back."""
    from lectern.plans.stream_queries import scratch

    chunks = views.written_chunks(spark, sf_dir)
    folder = scratch(spark, "artefacts")
    elements.write_tables({"windows": windows.artefacts(overflowed(chunks), chunks)}, folder)
    return elements.read_table(spark, folder, "windows").withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(
    "a13_workspace_sinks",
    f"WITH {views.BLOCKS}, {KEYWORDS} SELECT 'document' AS name, count(*) AS n, count(DISTINCT document_id) AS documents FROM (SELECT DISTINCT document_id FROM chunks) UNION ALL SELECT 'chunks', count(*), count(DISTINCT document_id) FROM chunks UNION ALL SELECT 'paragraphs', count(*), count(DISTINCT document_id) FROM blocks UNION ALL SELECT 'prompts', 2 * count(DISTINCT document_id), count(DISTINCT document_id) FROM blocks UNION ALL SELECT 'representations', 2 * count(*), count(DISTINCT document_id) FROM kw",
)
def a13(spark, sf_dir):
    """All five tables of a workspace, written by document and read back; those that follow from chunks and paragraphs are made of what was written of them."""
    from lectern.plans.stream_queries import scratch

    folder, chunks = scratch(spark, "workspace"), views.chunks(spark, sf_dir)
    elements.write_tables({"chunks": chunks, "paragraphs": blocks_of(chunks)}, folder)
    pages = elements.read_table(spark, folder, "chunks").groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    elements.write_tables({"document": pages, "representations": features.default_rows(elements.read_table(spark, folder, "paragraphs"), ["document_id", "block_no"])}, folder)
    owners = elements.read_table(spark, folder, "document").select("document_id")
    elements.write_tables({"prompts": owners.select("document_id", F.explode(F.array(F.lit("keywords"), F.lit("summary"))).alias("name"))}, folder)
    counts = [elements.read_table(spark, folder, name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents")).select(F.lit(name).alias("name"), "n", "documents") for name in ("document", "chunks", "paragraphs", "prompts", "representations")]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


# ---- features and plans


@query("f8_counters", f"WITH {views.BLOCKS}, {ROLLED.removeprefix('WITH ')}, n AS (SELECT *, {WORDS} AS words FROM blocks), g AS (SELECT DISTINCT document_id, block_no FROM state WHERE status = 'complete') SELECT n.document_id, count(*) FILTER (words > 20) AS eligible, count(g.block_no) AS generated, count(*) FILTER (words <= 20) AS skipped FROM n LEFT JOIN g ON g.document_id = n.document_id AND g.block_no = n.block_no GROUP BY 1")
def f8(spark, sf_dir):
    results = state(spark, sf_dir).where("status = 'complete'").select("document_id", "block_no")
    return features.counters(block_rows(spark, sf_dir), results, features.definitions(spark), ["document_id", "block_no"])


@query("f17_merge_by_block", f"WITH {views.BLOCKS}, {views.JOBS}, dn AS (SELECT document_id, block_no, string_agg(kind, ',' ORDER BY kind) AS v FROM state WHERE status = 'complete' GROUP BY 1, 2) SELECT b.document_id, b.block_no, coalesce(dn.v, b.text) AS representations FROM blocks b LEFT JOIN dn ON dn.document_id = b.document_id AND dn.block_no = b.block_no")
def f17(spark, sf_dir):
    """The blocks' texts stand for their old values; the kinds of completed jobs are the new ones."""
    blocks = block_rows(spark, sf_dir).select("document_id", "block_no", F.col("text").alias("representations"))
    done = state(spark, sf_dir).where("status = 'complete'").groupBy("document_id", "block_no").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("representations"))
    return features.replace_by_block(blocks, done, ["document_id", "block_no"])


@query("f19_clear_and_restore", f"WITH {views.BLOCKS}, {KEYWORDS} SELECT document_id, block_no, kind, value FROM (SELECT document_id, block_no, 'keywords' AS kind, keywords AS value FROM kw UNION ALL SELECT document_id, block_no, 'summary', {LEAD} FROM blocks) WHERE document_id % 2 = 1")
def f19(spark, sf_dir):
    """Documents with models on lose their placeholders, the others get theirs back."""
    return features.restored(block_rows(spark, sf_dir), F.col("document_id") % 2 == 0, ["document_id", "block_no"])


PROFILES = """CASE event_id % 9 WHEN 0 THEN concat('v', user_id % 3, '|provider=tagged|semantic=llm|semantic_model=m', user_id % 2) WHEN 1 THEN concat('v1|provider=tagged|semantic=llm|model=m', user_id % 2) WHEN 2 THEN concat('v1|provider=', event_type, '|semantic=heuristic|semantic_model=none') WHEN 3 THEN 'v1|provider=tagged|semantic=heuristic|semantic_model=old' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'v1|junk|provider=tagged|semantic=llm|semantic_model=|model=m1' WHEN 7 THEN concat('v1||provider=tagged|semantic=llm|semantic_model=m', user_id % 2) ELSE 'v1' END"""


@query(
    "f21_profile_match",
    f"""WITH p AS (SELECT event_id, coalesce({PROFILES}, '') AS s, CASE WHEN user_id % 3 = 0 THEN 'v1|provider=tagged|semantic=heuristic|semantic_model=none' ELSE 'v1|provider=tagged|semantic=llm|semantic_model=m1' END AS c FROM events),
    q AS (SELECT *, string_split(s, '|')[1] AS v, nullif(regexp_extract(s, '\\|provider=([^|]*)', 1), '') AS prov, nullif(regexp_extract(s, '\\|semantic=([^|]*)', 1), '') AS sem, coalesce(nullif(regexp_extract(s, '\\|semantic_model=([^|]*)', 1), ''), nullif(regexp_extract(s, '\\|model=([^|]*)', 1), '')) AS mod FROM p)
    SELECT event_id, s = c OR coalesce(v = 'v1' AND prov = 'tagged' AND sem = CASE WHEN c LIKE '%llm%' THEN 'llm' ELSE 'heuristic' END AND (c NOT LIKE '%llm%' OR mod = 'm1'), false) AS same FROM q""",
)
def f21(spark, sf_dir):
    """Stored profiles of several forms, older ones and broken ones, against two current ones."""
    current = F.when(F.col("user_id") % 3 == 0, "v1|provider=tagged|semantic=heuristic|semantic_model=none").otherwise("v1|provider=tagged|semantic=llm|semantic_model=m1")
    return events(spark, sf_dir).select("event_id", settings.profile_matches(F.expr(PROFILES), current).alias("same"))


PRINT = """substr(sha256(concat('{"keyword_min_words":', %s, ',"model":"', source, '"}')), 1, 16)"""


@query(
    "f22_incremental_plan",
    f"""WITH {ROLLED}, r AS (SELECT doc_id, source, lang = 'en' AS on_, 20 + doc_id % 2 AS words FROM documents), q AS (SELECT *, CASE WHEN on_ THEN {PRINT % 'words'} ELSE 'placeholder' END AS print, CASE WHEN on_ THEN {PRINT % '20'} ELSE 'placeholder' END AS dflt, CASE WHEN on_ THEN 'llm|' || source ELSE 'heuristic' END AS sem FROM r),
    c AS (SELECT q.doc_id, q.doc_id % 7 <> 0 AS version_ok, CASE q.doc_id % 5 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'llm|other' ELSE sem END AS csem, CASE q.doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN print ELSE 'stale' END AS cprint, rs.status, rs.failed FROM q JOIN (SELECT DISTINCT page_id FROM pages) ON page_id = q.doc_id LEFT JOIN rs ON rs.document_id = q.doc_id)
    SELECT q.doc_id AS document_id, CASE WHEN c.doc_id IS NULL OR NOT version_ok OR csem <> sem THEN 'parse' WHEN cprint IS NULL AND CASE WHEN on_ THEN coalesce(status = 'complete', false) AND print = dflt ELSE true END THEN 'adopt' WHEN cprint IS NULL OR cprint <> print THEN 'restart' WHEN on_ AND NOT coalesce(status = 'complete', false) THEN 'resume' ELSE 'keep' END AS action FROM q LEFT JOIN c USING (doc_id)""",
)
def f22(spark, sf_dir):
    """English documents ask for a model; pages say which are cached, job states how far they came."""
    n = F.col("doc_id")
    asked = documents(spark, sf_dir).select("doc_id", F.col("source").alias("model"), (F.col("lang") == "en").alias("enabled"), (n % 2 + 20).alias("keyword_min_words"))
    tagged, version = F.lit("tagged"), F.lit("v2")
    asked = asked.withColumn("representation_profile", features.fingerprint(asked, ["model", "keyword_min_words"], F.col("enabled"))).withColumn("cache_profile", settings.profile(version, tagged, F.col("enabled"), F.col("model")))
    plain = asked.withColumn("keyword_min_words", F.lit(20).cast("long"))
    requests = plain.withColumn("default_profile", features.fingerprint(plain, ["model", "keyword_min_words"], F.col("enabled"))).withColumn("document_id", n).withColumn("version", version)
    old = F.when(n % 5 == 0, settings.profile(version, tagged, F.lit(False), F.col("model"))).when(n % 5 == 1, settings.profile(version, tagged, F.lit(True), F.lit("other"))).otherwise(F.col("cache_profile"))
    stored = F.when(n % 3 == 1, F.col("representation_profile")).when(n % 3 == 2, "stale")
    cached = requests.join(pages(spark, sf_dir).select(F.col("page_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rolled = features.rollup(state(spark, sf_dir), ["document_id"]).select("document_id", "status", "failed")
    cache = cached.select("document_id", F.when(n % 7 == 0, "v1").otherwise("v2").alias("version"), old.alias("cache_profile"), stored.alias("representation_profile")).join(rolled.hint("merge"), "document_id", "left")
    return features.cache_plan(requests, cache)


@query(
    "f23_kinds",
    f"WITH {views.JOBS}, s AS (SELECT user_id AS id, 0 AS src, event_id AS pos, event_type AS name FROM events WHERE event_type <> 'error' UNION ALL SELECT document_id, 1, pos, kind || CASE WHEN block_no % 3 = 0 THEN '-x' ELSE '' END FROM jobs UNION ALL SELECT DISTINCT user_id, 2, p, k FROM events, (VALUES (0, 'keywords'), (1, 'summary')) v(p, k)), f AS (SELECT id, name, min((src, pos)) AS seen FROM s GROUP BY 1, 2) SELECT id AS document_id, CAST(row_number() OVER (PARTITION BY id ORDER BY seen) AS INT) AS pos, name FROM f",
)
def f23(spark, sf_dir):
    rows = events(spark, sf_dir)
    prompts = rows.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("name"))
    kinds = views.jobs(spark, sf_dir).select("document_id", "pos", F.concat("kind", F.when(F.col("block_no") % 3 == 0, "-x").otherwise("")).alias("kind"))
    return features.names(prompts, kinds, prompts.select("document_id").distinct())


@query("f23_first_of_kind", f"WITH {views.BLOCKS}, {KEYWORDS}, n AS (SELECT *, {WORDS} AS words FROM blocks), rp AS (SELECT document_id, block_no, 'keywords' AS kind, keywords AS value FROM kw JOIN n USING (document_id, block_no) WHERE words > 20 UNION ALL SELECT document_id, block_no, 'summary', {LEAD} FROM n WHERE words > 35) SELECT document_id, kind, arg_min(value, block_no) AS value FROM rp GROUP BY 1, 2")
def f23_first(spark, sf_dir):
    found = features.representations(block_rows(spark, sf_dir), features.definitions(spark), ["document_id", "block_no"])
    return features.first_of_kind(found.withColumnRenamed("block_no", "pos"))


@query("f25_provider_fallback", "SELECT user_id, coalesce(min(event_type) FILTER (event_type = 'view'), min(event_type)) AS provider FROM events GROUP BY 1")
def f25(spark, sf_dir):
    return features.provider_of(events(spark, sf_dir), "user_id", "event_type", "view")


@query(
    "f26_summary",
    f"WITH {views.CHUNKS}, {ROLLED}, pc AS (SELECT document_id, max(page_number) AS n FROM chunks GROUP BY 1), dd AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'tagged' WHEN 'de' THEN 'tagged' ELSE 'native' END AS prov, source FROM documents) SELECT id AS document_id, 'prepared/' || id || '/providers/' || prov || '/document.json' AS document_json, pc.n AS page_count, prov AS provider, complete AS completed_jobs, failed AS failed_jobs, status, total AS total_jobs, 'prepared/' || id || '/source.pdf' AS source_pdf, source AS title FROM dd LEFT JOIN pc ON pc.document_id = id LEFT JOIN rs ON rs.document_id = id",
)
def f26(spark, sf_dir):
    counts = views.chunks(spark, sf_dir).groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    named = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", "native").alias("provider"), F.col("source").alias("title"))
    return features.preparation_summary(named.join(counts.hint("merge"), "document_id", "left"), features.rollup(state(spark, sf_dir), ["document_id"]))


@query("f27_enable_default", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN true ELSE event_type = 'view' END AS enabled FROM events")
def f27(spark, sf_dir):
    flag = F.when(F.col("event_id") % 4 == 0, False).when(F.col("event_id") % 4 == 1, True)
    return events(spark, sf_dir).select("event_id", settings.enabled_default(flag, F.concat(F.lit(" "), F.upper("event_type")), "view").alias("enabled"))


# ---- overlays


@query(
    "g4_keyword_fallback",
    f"""WITH {views.BLOCKS}, ck AS (SELECT document_id, block_no, reading_order, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{2,}}'), 1) AS pos, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{2,}}'))) AS token FROM c3),
    c5 AS (SELECT document_id, block_no, reading_order, token, count(*) AS n, min(pos) AS pos FROM ck WHERE token NOT IN ({STOPS}) GROUP BY 1, 2, 3, 4), c6 AS (SELECT *, row_number() OVER (PARTITION BY document_id, reading_order ORDER BY n DESC, pos) AS rank FROM c5),
    c7 AS (SELECT document_id, block_no, reading_order, string_agg(replace(token, '-', ' '), ', ' ORDER BY rank) AS k FROM c6 WHERE rank <= 3 GROUP BY 1, 2, 3), c8 AS (SELECT document_id, block_no, arg_min(k, reading_order) AS k FROM c7 GROUP BY 1, 2)
    SELECT b.document_id, 'b' || b.block_no AS block_id, CASE WHEN b.document_id % 4 <> 0 AND {WORDS.replace('text', 'b.text')} <= 35 THEN c8.k END AS keywords FROM blocks b LEFT JOIN c8 USING (document_id, block_no)""",
)
def g4(spark, sf_dir):
    """Blocks of more than 35 words have a representation; every fourth document has models on."""
    chunks = views.written_chunks(spark, sf_dir)
    tagged = chunks.select("document_id", "chunk_id", F.filter(features.keywords_of(F.col("text")), lambda k: k != "keyword pending").alias("keywords"))
    blocks = blocks_of(chunks).select("document_id", F.concat(F.lit("b"), F.col("block_no").cast("string")).alias("block_id"), "chunk_ids", (tx.word_count(F.col("text")) > 35).alias("has_representations"))
    return overlays.keyword_fallback(blocks, tagged, F.col("document_id") % 4 == 0).withColumn("keywords", F.array_join("keywords", ", "))


@query(
    "g9_other_kinds",
    f"WITH {views.BLOCKS}, pl AS (SELECT document_id, block_no, len(chunk_ids) AS n, unnest(CASE WHEN block_no % 2 = 0 THEN [('tone', 0), ('gist', 1), ('form', 2)] ELSE [('gist', 0)] END) AS k FROM blocks) SELECT document_id, block_no, k[1] AS kind, CAST(CASE block_no % 3 WHEN 0 THEN 0 WHEN 1 THEN n - 1 ELSE k[2] % n END AS INT) AS region FROM pl",
)
def g9(spark, sf_dir):
    """Even blocks have three other kinds, one of them twice, odd ones one; the summary or the keywords have a region or not."""
    n, size = F.col("block_no"), F.size("chunk_ids")
    listed = lambda *kinds: F.array(*[F.struct(F.lit(k).alias("kind")) for k in kinds])
    found = overlays.place_others(F.when(n % 2 == 0, listed("summary", "tone", "gist", "tone", "", "form")).otherwise(listed("keywords", "gist")), F.when(n % 3 == 0, 0), F.when(n % 3 == 1, size - 1), size)
    return block_rows(spark, sf_dir).select("document_id", "block_no", F.explode(found).alias("p")).select("document_id", "block_no", "p.kind", "p.region")


# ---- exams


def exams(spark, sf_dir):
    """Exam records nested from events: three questions each, one with a single choice, one with none, and an entry that is none."""
    n = F.col("event_id")
    question = lambda t, c, a: F.struct(t.cast("string").alias("text"), F.array(*map(F.lit, c)).cast("array<string>").alias("choices"), a.cast("int").alias("answer_index"))
    asked = F.array(question(F.lit("First?"), ["only", " "], n % 5 - 1), F.lit(None), question(F.lit(None), ["", " "], n % 3), question(F.lit("Last?"), ["a", "b", " c "], n % 7))
    mode = F.when(n % 4 == 0, " Stopwatch").when(n % 4 == 1, "COUNTDOWN").when(n % 4 == 2, "odd")
    limit = F.when(n % 5 == 0, "soon").otherwise((n % 600).cast("string"))
    shown = F.when(n % 6 > 0, F.array(F.lit(" keywords"), F.when(n % 2 == 0, "summary").otherwise(" ")))
    return events(spark, sf_dir).select(
        F.when(n % 3 > 0, F.concat(F.lit("exams/Exam "), n.cast("string"), F.lit(".json"))).otherwise("").alias("id"),
        F.concat(F.lit("file "), n.cast("string")).alias("fallback_id"),
        F.col("user_id").cast("string").alias("document_id"),
        F.when(n % 8 > 0, F.concat(F.lit("T"), n.cast("string"))).alias("title"),
        F.when(n % 9 > 0, F.col("event_type")).alias("question_set_id"),
        F.when(n % 10 == 0, False).alias("enabled"),
        mode.alias("timing_mode"),
        limit.alias("time_limit_seconds"),
        F.when(n % 11 == 0, "own").alias("condition_id"),
        shown.alias("visible"),
        asked.alias("questions"),
    )


EXAMS = """xl AS (SELECT event_id AS n, CASE WHEN event_id % 3 > 0 THEN 'exam-' ELSE 'file-' END || event_id AS exam_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(event_id % 600 AS INT) END AS asked FROM events),
xm AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'stopwatch' WHEN n % 4 = 1 THEN 'countdown' WHEN asked > 0 THEN 'countdown' ELSE 'stopwatch' END AS timing_mode, CASE WHEN n % 4 = 0 OR (n % 4 > 1 AND asked = 0) THEN 0 ELSE asked END AS lim, CASE WHEN n % 11 = 0 THEN 'own' WHEN n % 6 = 0 THEN 'none' WHEN n % 2 = 0 THEN 'keywords-summary' ELSE 'keywords' END AS condition_id FROM xl),
xq AS (SELECT n, exam_id, exam_id || '-q1' AS question_id, 'First?' AS text, 'only' AS choices, 0 AS answer_index FROM xm UNION ALL SELECT n, exam_id, exam_id || '-q3', 'Question 3', 'Choice 1|Choice 2', CAST(least(n % 3, 1) AS INT) FROM xm UNION ALL SELECT n, exam_id, exam_id || '-q4', 'Last?', 'a|b| c ', CAST(least(n % 7, 2) AS INT) FROM xm)"""


@query("i1_exam_normalise", f"WITH {EXAMS}, q AS (SELECT n, string_agg(question_id || ':' || text || ':' || choices || ':' || answer_index, ';' ORDER BY question_id) AS questions FROM xq GROUP BY 1) SELECT exam_id, CAST(user_id AS VARCHAR) AS document_id, CASE WHEN n % 8 > 0 THEN 'T' || n ELSE exam_id END AS title, CASE WHEN n % 9 > 0 THEN event_type ELSE exam_id || '-questions' END AS question_set_id, n % 10 <> 0 AS enabled, timing_mode, lim AS time_limit_seconds, condition_id, questions FROM xm JOIN q USING (n)")
def i1(spark, sf_dir):
    shown = F.transform("questions", lambda q: F.concat_ws(":", q["question_id"], q["text"], F.array_join(q["choices"], "|"), q["answer_index"].cast("string")))
    return study.normalise_exams(exams(spark, sf_dir)).withColumn("questions", F.array_join(shown, ";"))


@query("a15_private_keys", f"WITH {EXAMS} SELECT question_id, answer_index FROM xq")
def a15(spark, sf_dir):
    return study.private_keys(study.normalise_exams(exams(spark, sf_dir)))


@query("a15_public_questions", f"WITH {EXAMS} SELECT question_id, text, choices FROM xq")
def a15_public(spark, sf_dir):
    return study.public_questions(study.normalise_exams(exams(spark, sf_dir))).withColumn("choices", F.array_join("choices", "|"))


@query("a15_public_exams", f"WITH {EXAMS}, q AS (SELECT *, CASE WHEN n % 9 > 0 THEN event_type ELSE exam_id || '-questions' END AS qs FROM xm) SELECT exam_id, CAST(user_id AS VARCHAR) AS document_id, CASE WHEN n % 8 > 0 THEN 'T' || n ELSE exam_id END AS title, qs AS question_set_id, timing_mode, lim AS time_limit_seconds, condition_id, '/study-cache/questions/' || qs || '.json' AS question_url FROM q WHERE n % 10 <> 0")
def a15_exams(spark, sf_dir):
    return study.public_exams(study.enabled_exams(study.normalise_exams(exams(spark, sf_dir))))


@query("h4_projection", f"WITH {EXAMS}, q AS (SELECT *, CASE WHEN n % 9 > 0 THEN event_type ELSE exam_id || '-questions' END AS qs FROM xm) SELECT exam_id, CASE WHEN n % 14 = 0 THEN 'default' ELSE condition_id END AS condition_id, CAST(user_id AS VARCHAR) AS document_id, qs AS question_set_id, CASE WHEN n % 4 = 0 THEN 'own/' || n ELSE '/study-cache/questions/' || qs || '.json' END AS question_url, CASE WHEN n % 2 = 0 THEN 'keywords' ELSE '' END AS visible, CASE WHEN n % 12 = 0 THEN 0 ELSE lim END AS time_limit_seconds FROM q")
def h4(spark, sf_dir):
    """Exams of a manifest, some without a condition, an address of their own, a list of kinds or a limit."""
    n = F.regexp_extract("exam_id", "([0-9]+)$", 1).cast("long")
    rows = study.normalise_exams(exams(spark, sf_dir))
    rows = rows.withColumn("condition_id", F.when(n % 14 != 0, F.col("condition_id"))).withColumn("question_url", F.when(n % 4 == 0, F.concat(F.lit("own/"), n.cast("string"))).otherwise(" "))
    rows = rows.withColumn("visible", F.when(n % 2 == 0, F.array(F.lit("keywords")))).withColumn("time_limit_seconds", F.when(n % 12 != 0, F.col("time_limit_seconds")))
    return study.assignment(rows).withColumn("visible", F.array_join("visible", ","))


@query("i6_results", f"WITH {SCORED}, rt AS (SELECT session_id, max(submitted_at) AS ended FROM submissions GROUP BY 1) SELECT session_id, correct, total, strftime(ended, '%Y-%m-%dT%H:%M:%SZ') AS received_at, 'pilot-1' AS study_id, 'study-results/pilot-1/' || strftime(ended, '%Y-%m-%d') || '/' || session_id || '.json' AS result_key FROM scored JOIN rt USING (session_id)")
def i6(spark, sf_dir):
    rows = views.submissions(spark, sf_dir)
    received = rows.groupBy("session_id").agg(F.max("submitted_at").alias("received_at"))
    return study.result_rows(study.score(rows, views.answer_key(spark)).join(received.hint("merge"), "session_id"), "pilot 1").drop("details")
