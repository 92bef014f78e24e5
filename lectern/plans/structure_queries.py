"""Queries of layout, outline, windows and group repair (inventory D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import layout, windows
from lectern.plans import views
from lectern.plans.registry import query
from lectern.plans.text_queries import DEPTH, HEADING_LIKE, block_rows

R = "round({}, 6)"


def assembled(spark, sf_dir):
    return layout.assemble(layout.with_body_font(layout.reading_blocks(views.chunks(spark, sf_dir))), ["document_id", "block_no"])


ASSEMBLED = (
    views.BLOCKS
    + """,
asm AS (SELECT document_id, CAST(block_no AS INT) AS block_no, min(page_number) AS page_number, string_agg(trim(text), ' ' ORDER BY reading_order) AS text, coalesce(median(font_size), 12) AS font_size, bool_or(is_bold) AS is_bold,
 min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM c3 GROUP BY 1, 2),
bf AS (SELECT document_id, coalesce(median(font_size), 12) AS body FROM chunks GROUP BY 1),
roled AS (SELECT asm.*, body, CASE WHEN trim(text) = '' THEN 'paragraph' WHEN %s <= 1 THEN 'section' WHEN %s > 1 THEN 'subsection' WHEN %s AND font_size >= body * 1.30 THEN 'section' WHEN %s AND (font_size >= body * 1.12 OR is_bold) THEN 'subsection' ELSE 'paragraph' END AS role FROM asm JOIN bf USING (document_id))
"""
    % (DEPTH, DEPTH, HEADING_LIKE, HEADING_LIKE)
)


def roled(spark, sf_dir):
    return assembled(spark, sf_dir).withColumn("role", layout.role(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("body_font")))


@query("d1_body_font", f"WITH {views.CHUNKS} SELECT document_id, coalesce(median(font_size), 12) AS body_font FROM chunks GROUP BY 1")
def d1(spark, sf_dir):
    return layout.body_font(views.chunks(spark, sf_dir))


@query("d2_group_box", f"WITH {views.CHUNKS} SELECT document_id, page_number, min(x) AS x, min(y) AS y, {R.format('max(x + width) - min(x)')} AS width, {R.format('max(y + height) - min(y)')} AS height FROM chunks GROUP BY 1, 2")
def d2(spark, sf_dir):
    found = layout.group_box(views.chunks(spark, sf_dir), ["document_id", "page_number"])
    return found.withColumn("width", F.round("width", 6)).withColumn("height", F.round("height", 6))


@query(
    "d3_overlap",
    f"WITH {views.CHUNKS}, q AS (SELECT document_id, reading_order, x, width, lag(x) OVER o AS px, lag(width) OVER o AS pw FROM chunks WINDOW o AS (PARTITION BY document_id ORDER BY reading_order))"
    " SELECT document_id, reading_order, round(greatest(0, least(px + pw, x + width) - greatest(px, x)) / greatest(least(pw, width), 1e-6), 6) AS overlap FROM q WHERE px IS NOT NULL",
)
def d3(spark, sf_dir):
    return layout.overlaps(views.chunks(spark, sf_dir))


@query("d6_assembly", f"WITH {ASSEMBLED} SELECT document_id, block_no, page_number, text, font_size, is_bold, x, y, round(width, 6) AS width, round(height, 6) AS height FROM asm")
def d6(spark, sf_dir):
    return assembled(spark, sf_dir).drop("chunk_ids", "body_font").withColumn("width", F.round("width", 6)).withColumn("height", F.round("height", 6))


@query("d8_roles", f"WITH {ASSEMBLED} SELECT document_id, block_no, role FROM roled")
def d8(spark, sf_dir):
    return roled(spark, sf_dir).select("document_id", "block_no", "role")


SECTIONED = (
    ASSEMBLED
    + """,
sec AS (SELECT *, count(*) FILTER (role = 'section') OVER (PARTITION BY document_id ORDER BY block_no) AS sno, coalesce(last_value(CASE WHEN role = 'section' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_no), 'Body') AS stext FROM roled),
sub AS (SELECT *, last_value(CASE WHEN role = 'subsection' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id, sno ORDER BY block_no) AS subtext FROM sec),
sectioned AS (SELECT *, concat_ws(' > ', stext, subtext) AS path FROM sub)
"""
)


def sectioned(spark, sf_dir):
    return layout.section_paths(roled(spark, sf_dir), "block_no")


@query("d9_section_path", f"WITH {SECTIONED} SELECT document_id, block_no, path FROM sectioned WHERE role = 'paragraph'")
def d9(spark, sf_dir):
    return sectioned(spark, sf_dir).where("role = 'paragraph'").select("document_id", "block_no", F.array_join("section_path", " > ").alias("path"))


@query("d10_block_ids", f"WITH {SECTIONED} SELECT document_id, block_no, format('block-{{:03d}}-{{:04d}}', page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_no)) AS block_id FROM sectioned WHERE role = 'paragraph'")
def d10(spark, sf_dir):
    return layout.page_numbered(roled(spark, sf_dir).where("role = 'paragraph'"), "block_no").select("document_id", "block_no", "block_id")


@query(
    "d12_path_nodes",
    f"WITH {SECTIONED}, pre AS (SELECT document_id, block_no, 1 AS level, stext AS path, stext AS title FROM sectioned WHERE role = 'paragraph' UNION ALL SELECT document_id, block_no, 2, stext || ' > ' || subtext, subtext FROM sectioned WHERE role = 'paragraph' AND subtext IS NOT NULL),"
    " fst AS (SELECT document_id, path, title, level, min(block_no) AS seen FROM pre GROUP BY ALL), num AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seen, level) AS n FROM fst)"
    " SELECT document_id, format('{}-{:03d}', CASE WHEN level = 1 THEN 'section' ELSE 'subsection' END, n) AS node_id, path, level, title, CASE WHEN level = 1 THEN 'section' ELSE 'subsection' END AS node_type FROM num",
)
def d12(spark, sf_dir):
    return layout.path_nodes(sectioned(spark, sf_dir).where("role = 'paragraph'"), "block_no")


@query("d19_tokens", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM documents")
def d19(spark, sf_dir):
    from lectern.plans.text_queries import documents

    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(tx.alignment_tokens(F.col("text"))), " ").alias("tokens"))


@query("e1_reading_order", f"WITH {views.CHUNKS} SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order) - 1 AS n FROM chunks")
def e1(spark, sf_dir):
    return layout.in_reading_order(views.chunks(spark, sf_dir)).select("document_id", "chunk_id", "n")


PACKED = (
    "RECURSIVE "
    + views.CHUNKS
    + """,
pk AS (SELECT document_id, reading_order, page_number, length(text) AS n, 0 AS w, 1 AS k, length(text) AS c FROM chunks WHERE reading_order = 0
 UNION ALL
 SELECT c.document_id, c.reading_order, c.page_number, length(c.text), CASE WHEN f THEN p.w + 1 ELSE p.w END, CASE WHEN f THEN 1 ELSE p.k + 1 END, CASE WHEN f THEN length(c.text) ELSE p.c + length(c.text) END
 FROM (SELECT pk.*, ch.text AS t, (pk.k >= 12 OR pk.c + length(ch.text) > 6000 OR (pk.page_number <> ch.page_number AND pk.k >= 6)) AS f FROM pk JOIN chunks ch ON ch.document_id = pk.document_id AND ch.reading_order = pk.reading_order + 1) p
 JOIN chunks c ON c.document_id = p.document_id AND c.reading_order = p.reading_order + 1),
win AS (SELECT document_id, reading_order, w AS window_no, n AS n_chars FROM pk)
"""
)


@query("e2_windows", f"WITH {PACKED} SELECT * FROM win")
def e2(spark, sf_dir):
    return windows.pack_windows(views.chunks(spark, sf_dir))


def path_groups(spark, sf_dir):
    path = F.when(F.col("block_no") % 4 == 1, F.concat(F.lit("S"), (F.col("block_no") % 7).cast("string"))).otherwise("")
    return block_rows(spark, sf_dir).withColumn("path", path)


PATHED = views.BLOCKS + ", pg AS (SELECT *, CASE WHEN block_no % 4 = 1 THEN 'S' || (block_no % 7) ELSE '' END AS path FROM blocks), filled AS (SELECT document_id, block_no, text, last_value(nullif(path, '') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_no) AS path FROM pg)"


@query("e6_fill_paths", f"WITH {PATHED} SELECT document_id, block_no, path FROM filled")
def e6(spark, sf_dir):
    return windows.fill_paths(path_groups(spark, sf_dir), "block_no").select("document_id", "block_no", "path")


@query(
    "e8_merge_continuations",
    f"WITH {views.CHUNKS}, mg AS (SELECT document_id, reading_order, lag(text) OVER o AS a, text AS b, lag(page_number) OVER o AS pp, page_number FROM chunks WINDOW o AS (PARTITION BY document_id ORDER BY reading_order)), op AS (SELECT *, CASE WHEN pp = page_number AND ({views.CONTINUES}) THEN 0 ELSE 1 END AS opens FROM mg)"
    " SELECT document_id, reading_order, CAST(sum(opens) OVER (PARTITION BY document_id ORDER BY reading_order) AS INT) AS merged_no FROM op",
)
def e8(spark, sf_dir):
    groups = views.chunks(spark, sf_dir).select("document_id", "reading_order", "text", F.col("page_number").alias("path"), F.lit("body").alias("role"))
    return windows.merge_continuations(groups, "reading_order").select("document_id", "reading_order", "merged_no")
