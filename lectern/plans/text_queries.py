"""Queries of sources, scalars and predicates (inventory A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import boxes
from lectern.functions import text as tx
from lectern.plans import views
from lectern.plans.registry import query
from lectern.session import prepare, table
from lectern.sources import markup, records


def documents(spark, sf_dir):
    return table(prepare(spark), sf_dir, "documents")


def pages(spark, sf_dir):
    return table(prepare(spark), sf_dir, "pages")


def events(spark, sf_dir):
    return table(prepare(spark), sf_dir, "events")


@query("a2_content_dedup", "SELECT sha256(text) AS document_id, min(doc_id) AS created_at, arg_max(source, doc_id) AS source_name FROM documents GROUP BY 1")
def a2(spark, sf_dir):
    return records.latest_documents(documents(spark, sf_dir).select(F.sha2("text", 256).alias("document_id"), F.col("doc_id").alias("uploaded_at"), F.col("source").alias("source_name")))


@query("a3_manifest_upsert", f"WITH {views.JOBS} SELECT document_id, kind AS provider, arg_max(status, pos) AS status, max(pos) AS pos FROM jobs GROUP BY 1, 2")
def a3(spark, sf_dir):
    return records.latest_of_provider(views.jobs(spark, sf_dir).select("document_id", F.col("kind").alias("provider"), "status", "pos"))


def edited_pages(spark, sf_dir):
    """Pages with what markup can hold: character references, comments with tags in them, CDATA, quoted `>`, prefixes, capitals, a note with a paragraph of its own
    inside a paragraph, and a blank title before the real one. Every fourth page stays as it is."""
    n, html = F.col("page_id") % 4, F.col("html")
    rich = F.replace(F.replace(html, F.lit("<p>"), F.lit('<P class="a>b">&#233;&#xE9; &amp;#65;<!-- <p>no</p> --> <![CDATA[<p> & ]]>')), F.lit("<title>"), F.lit("<title> </title><TITLE lang='en'>"))
    noted = F.replace(html, F.lit("<article>"), F.lit("<article><p>before <note>n<p>inner</p></note> after</p>"))
    prefixed = F.replace(F.replace(F.replace(html, F.lit("<p>"), F.lit("<t:p>")), F.lit("</p>"), F.lit("</t:p>")), F.lit("<title>"), F.lit("<title><!-- none --></title><title>&lt;"))
    return pages(spark, sf_dir).select("page_id", F.when(n == 1, rich).when(n == 2, noted).when(n == 3, prefixed).otherwise(html).alias("html"))


EDITED = """, ed AS (SELECT document_id, CASE WHEN document_id % 4 = 2 THEN unit_no + 2 ELSE unit_no END AS unit_no, tag, CASE WHEN document_id % 4 = 1 AND tag = 'p' THEN trim('éé &#65; <p> & ' || text) ELSE text END AS text FROM elements
 UNION ALL SELECT page_id, 0, 'p', 'before n inner after' FROM pages WHERE page_id % 4 = 2 AND contains(html, '<article>') UNION ALL SELECT page_id, 1, 'p', 'inner' FROM pages WHERE page_id % 4 = 2 AND contains(html, '<article>'))"""


@query("a5_body_units", f"WITH {views.ELEMENTS} {EDITED} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY unit_no) AS unit_no, tag, text, CASE WHEN tag = 'p' THEN 'paragraph' ELSE 'heading' END AS role FROM ed WHERE text <> ''")
def a5(spark, sf_dir):
    found = markup.roles(markup.body_units(edited_pages(spark, sf_dir), "page_id", "html").withColumnRenamed("page_id", "document_id"))
    return found.withColumn("unit_no", F.row_number().over(Window.partitionBy("document_id").orderBy("unit_no")).cast("long"))


#: Character references of t: numeric ones and the five of markup, each once; others stay.
DECODED = r"""array_to_string(list_prepend(string_split(t, '&')[1], list_transform(string_split(t, '&')[2:], lambda p: coalesce(
 CASE WHEN starts_with(p, 'lt;') THEN '<' WHEN starts_with(p, 'gt;') THEN '>' WHEN starts_with(p, 'quot;') THEN '"' WHEN starts_with(p, 'apos;') THEN chr(39) WHEN starts_with(p, 'amp;') THEN '&'
 ELSE list_transform(list_filter([coalesce(TRY_CAST(nullif(regexp_extract(p, '^#([0-9]{1,7});', 1), '') AS INT), TRY_CAST('0x' || nullif(regexp_extract(p, '^#[xX]([0-9A-Fa-f]{1,6});', 1), '') AS INT))], lambda c: c > 0 AND c < 1114112 AND NOT c BETWEEN 55296 AND 57343), lambda c: chr(c))[1] END
 || regexp_replace(p, '^[^;]*;', ''), '&' || p))), '')"""


@query("a6_title", rf"""WITH tt AS (SELECT page_id, generate_subscripts(a, 1) AS pos, unnest(a) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1) AS a FROM pages)),
 dt AS (SELECT page_id, pos, trim(regexp_replace(CASE WHEN page_id % 4 = 3 THEN '<' ELSE '' END || {DECODED}, '[ \t\n\r]+', ' ', 'g')) AS t FROM tt)
 SELECT page_id, (SELECT arg_min(t, pos) FROM dt WHERE dt.page_id = pages.page_id AND t <> '') AS title FROM pages""")
def a6(spark, sf_dir):
    return edited_pages(spark, sf_dir).select("page_id", markup.title(F.col("html")).alias("title"))


def block_rows(spark, sf_dir):
    return blocks_of(views.chunks(spark, sf_dir))


def blocks_of(chunks):
    """Paragraph blocks of chunks: document_id, block_no, page_number, text, chunk_ids."""
    from lectern.operators.layout import reading_blocks

    parts = reading_blocks(chunks).groupBy("document_id", "block_no").agg(F.min("page_number").alias("page_number"), F.sort_array(F.collect_list(F.struct("reading_order", F.trim("text").alias("t"), "chunk_id"))).alias("p"))
    return parts.select("document_id", "block_no", "page_number", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"))


@query("b1_collapse", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g')) AS text FROM documents")
def b1(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.collapse(F.col("text")).alias("text"))


@query(
    "b2_join_lines",
    r"SELECT doc_id, replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '(er|en) ', '\1-' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '-\n(\p{Ll})', '\1', 'g'), chr(10), ' ') AS text FROM documents",
)
def b2(spark, sf_dir):
    broken = F.regexp_replace("text", "(er|en) ", "$1-\n")
    return documents(spark, sf_dir).select("doc_id", tx.join_lines(F.split(broken, "\n")).alias("text"))


B3_JSON = "CASE event_id % 4 WHEN 0 THEN concat('[', user_id, ',', event_id % 7, ',', user_id + 5, ',', event_id % 7 + 3, ']') WHEN 1 THEN concat('{\"left\":', user_id, ',\"y1\":', event_id % 7, ',\"r\":', user_id - 5 + event_id % 11, ',\"top\":', event_id % 7 + 3, '}') WHEN 2 THEN concat('{\"left\":', user_id, '}') ELSE '\"none\"' END"


def b3_rows(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", boxes.parse_box(F.expr(B3_JSON)).alias("box"))


B3_SQL = f"j AS (SELECT event_id, {B3_JSON} AS j FROM events), b AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN coalesce(json_extract_string(j, '$[0]'), json_extract_string(j, '$.left')) END::DOUBLE AS l, CASE WHEN event_id % 4 < 2 THEN coalesce(json_extract_string(j, '$[1]'), json_extract_string(j, '$.y1')) END::DOUBLE AS b, CASE WHEN event_id % 4 < 2 THEN coalesce(json_extract_string(j, '$[2]'), json_extract_string(j, '$.r')) END::DOUBLE AS r, CASE WHEN event_id % 4 < 2 THEN coalesce(json_extract_string(j, '$[3]'), json_extract_string(j, '$.top')) END::DOUBLE AS t FROM j)"


@query("b3_parse_box", f"WITH {B3_SQL} SELECT * FROM b")
def b3(spark, sf_dir):
    return b3_rows(spark, sf_dir).select("event_id", "box.l", "box.b", "box.r", "box.t")


@query(
    "b4_normalise_box",
    f"WITH {B3_SQL} SELECT event_id, round(least(greatest(l / 900, 0), 1), 9) AS x, round(least(greatest(1 - t / 8, 0), 1), 9) AS y, round(least(greatest((r - l) / 900, 0), 1), 9) AS width, round(least(greatest((t - b) / 8, 0), 1), 9) AS height FROM b WHERE r > l AND t > b",
)
def b4(spark, sf_dir):
    box = boxes.normalise_box(F.col("box"), F.lit(900.0), F.lit(8.0))
    rows = b3_rows(spark, sf_dir).select("event_id", box.alias("n")).where("n IS NOT NULL")
    return rows.select("event_id", *(F.round(f"n.{c}", 9).alias(c) for c in ("x", "y", "width", "height")))


@query("b7_chunk_id", f"WITH {views.CHUNKS} SELECT document_id, reading_order, format('text-{{:03d}}-{{:04d}}', page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order)) AS chunk_id FROM chunks")
def b7(spark, sf_dir):
    order = Window.partitionBy("document_id", "page_number").orderBy("reading_order")
    return views.chunks(spark, sf_dir).select("document_id", "reading_order", F.format_string("text-%03d-%04d", "page_number", F.row_number().over(order)).alias("chunk_id"))


@query(
    "b8_identifiers",
    r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'default') AS artifact, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'none') AS block, substr(regexp_replace(coalesce(nullif(' ' || url, ' '), 'unknown'), '[^A-Za-z0-9_.-]+', '-', 'g'), 1, 96) AS segment FROM pages",
)
def b8(spark, sf_dir):
    url = F.col("url")
    return pages(spark, sf_dir).select("page_id", tx.artifact_name(url).alias("artifact"), tx.block_id(url, F.lit("none")).alias("block"), tx.path_segment(F.concat(F.lit(" "), url)).alias("segment"))


C = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("b9_short_title", f"SELECT doc_id, CASE WHEN length({C}) <= 56 THEN {C} ELSE rtrim(substr({C}, 1, 53)) || '...' END AS title, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '...' ELSE text END AS preview FROM documents")
def b9(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.short_title(F.col("text")).alias("title"), tx.preview(F.col("text"), 80).alias("preview"))


@query("b10_kind_label", "SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) || ' Of ' || upper(chr(97 + CAST(event_id % 26 AS INT))) AS label FROM events")
def b10(spark, sf_dir):
    kind = F.concat(F.upper("event_type"), F.lit("_of_"), F.expr("chr(97 + event_id % 26)"))
    return events(spark, sf_dir).select("event_id", tx.kind_label(kind).alias("label"))


@query("b19_keywords", r"WITH k AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS pos, trim(trim(regexp_replace(unnest(string_split(text, ' ')), '\s+', ' ', 'g')), ' .,:;') AS k FROM documents), f AS (SELECT doc_id, lower(k) AS l, arg_min(k, pos) AS k, min(pos) AS pos FROM k WHERE k <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f) SELECT doc_id, string_agg(k, '|' ORDER BY n) AS keywords FROM r WHERE n <= 5 GROUP BY 1 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)")
def b19(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(tx.clean_keywords(F.split("text", " "), 5), "|").alias("keywords"))


@query("b20_summary_cap", f"WITH s AS (SELECT doc_id, {C} AS t, string_split({C}, ' ') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 41 THEN rtrim(array_to_string(w[1:41], ' '), ' ,;:') || '...' ELSE t END AS summary FROM s")
def b20(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.cap_summary(F.col("text"), F.lit(30)).alias("summary"))


@query("b21_elapsed", "SELECT event_id, format('{}:{:02d}', event_id // 60, event_id % 60) AS elapsed, CASE WHEN event_id % 7 > 0 THEN CAST(round(100.0 * (event_id % 5) / (event_id % 7)) AS INT) ELSE 0 END AS percent FROM events")
def b21(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", tx.elapsed(F.col("event_id")).alias("elapsed"), tx.percent(F.col("event_id") % 5, F.col("event_id") % 7).alias("percent"))


@query("b23_page_font", f"WITH {views.CHUNKS}, f AS (SELECT *, CASE reading_order % 4 WHEN 0 THEN ' ' WHEN 2 THEN ' Font' || (document_id + reading_order) % 3 WHEN 3 THEN 'Bold' END AS font_name FROM chunks) SELECT document_id, page_number, median(font_size) AS font_size, arg_min(trim(font_name), reading_order) FILTER (trim(font_name) <> '') AS font_name FROM f GROUP BY 1, 2")
def b23(spark, sf_dir):
    """Spans with blank names, without any, and of several fonts."""
    from lectern.operators.layout import representative_font

    n = F.col("reading_order")
    name = F.when(n % 4 == 0, " ").when(n % 4 == 2, F.concat(F.lit(" Font"), ((F.col("document_id") + n) % 3).cast("string"))).when(n % 4 == 3, "Bold")
    return representative_font(views.chunks(spark, sf_dir).withColumn("font_name", name), ["document_id", "page_number"], "reading_order")


@query("c1_continuation", f"WITH {views.CHUNKS}, pr AS (SELECT document_id, reading_order, lag(text) OVER (PARTITION BY document_id ORDER BY reading_order) AS a, text AS b FROM chunks) SELECT document_id, reading_order, {views.CONTINUES} AS goes_on FROM pr")
def c1(spark, sf_dir):
    order = Window.partitionBy("document_id").orderBy("reading_order")
    return views.chunks(spark, sf_dir).select("document_id", "reading_order", tx.continues(F.lag("text").over(order), F.col("text")).alias("goes_on"))


NUMBERED = r"regexp_matches(trim(text), '^(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+\S')"
DEPTH = r"CASE WHEN regexp_extract(trim(text), '^(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+\S', 1) <> '' THEN length(regexp_extract(trim(text), '^(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+\S', 1)) - length(replace(regexp_extract(trim(text), '^(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+\S', 1), '.', '')) + 1 END"
HEADING_LIKE = f"({C} <> '' AND length({C}) <= 140 AND len(string_split({C}, ' ')) <= 14 AND NOT regexp_matches({C}, '[.?!]$'))"


@query("c2_numbered", f"WITH {views.CHUNKS} SELECT document_id, reading_order, {NUMBERED} AS numbered, {DEPTH} AS depth FROM chunks")
def c2(spark, sf_dir):
    return views.chunks(spark, sf_dir).select("document_id", "reading_order", tx.numbered(F.col("text")).alias("numbered"), tx.numbered_depth(F.col("text")).cast("long").alias("depth"))


@query("c3_heading_like", f"WITH {views.CHUNKS} SELECT document_id, reading_order, {HEADING_LIKE} AS heading_like FROM chunks")
def c3(spark, sf_dir):
    return views.chunks(spark, sf_dir).select("document_id", "reading_order", tx.heading_like(F.col("text")).alias("heading_like"))


@query(
    "c6_validation",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'Missing study_id.' WHEN user_id % 11 = 0 THEN 'Missing participant_id.' WHEN event_id % 13 = 0 THEN 'Missing session_id.' WHEN event_id % 17 = 0 THEN 'Missing question_set_id.' WHEN event_id % 19 = 0 THEN 'Missing answers.' END AS error FROM events",
)
def c6(spark, sf_dir):
    """Both halves of the split, put together again."""
    from lectern.operators.study import split_valid

    n = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("study_id"),
        F.when(F.col("user_id") % 11 != 0, F.col("user_id").cast("string")).alias("participant_id"),
        F.when(n % 13 != 0, F.lit("s")).otherwise("").alias("session_id"),
        F.when(n % 34 != 0, F.struct(F.when(n % 17 != 0, "set").alias("question_set_id"))).alias("assignment"),
        F.when(n % 19 != 0, F.array().cast("array<struct<question_id:string,selected_index:int>>")).alias("answers"),
    )
    valid, invalid = split_valid(rows)
    return valid.unionByName(invalid, allowMissingColumns=True).select("event_id", "error")
