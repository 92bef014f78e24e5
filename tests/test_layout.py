"""Layout paragraphs against a plain loop, and golden cases of titles, outlines and edited blocks."""

import statistics

from conftest import SMALL
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import layout
from lectern.plans import views

CHUNK = "document_id long, page_number int, reading_order int, text string, x double, y double, width double, height double, font_size double, is_bold boolean, chunk_id string"


def test_paragraphs_of_the_whole_table(spark):
    """The rule over plain rows: boxes grow with what is merged, headings stand alone, the sentence must go on."""
    rows = layout.columns_of_page(layout.with_body_font(views.chunks(spark, SMALL))).withColumn("next", F.lead("text").over(layout.Window.partitionBy("document_id", "page_number", "column_no").orderBy("y", "x", "reading_order")))
    heading = tx.heading_chunk(F.col("text"), F.lit(None).cast("string"), F.col("is_bold"), F.col("font_size"), F.col("body_font"))
    rows = rows.withColumn("heading", heading).withColumn("on", tx.continues(F.col("text"), F.col("next"))).cache()
    columns = {}
    for r in rows.collect():
        columns.setdefault((r["document_id"], r["page_number"], r["column_no"]), []).append(r)
    expected = set()
    for key, own in columns.items():
        number, box, last = 0, None, None
        for r in sorted(own, key=lambda r: (r["y"], r["x"], r["reading_order"])):
            left, top, right, bottom = r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]
            merged = False
            if last is not None and not last["heading"] and not r["heading"] and last["on"]:
                gap = max(top - box[3], 0)
                fonts = (last["font_size"], r["font_size"])
                overlap = max(0, min(box[2], right) - max(box[0], left)) / max(min(box[2] - box[0], right - left), 1e-6)
                beside = overlap >= 0.25 or abs(left - box[0]) <= 0.05 or abs((left + right - box[0] - box[2]) / 2) <= 0.06
                merged = gap <= max(2 * (box[3] - box[1]), 2 * (bottom - top), 0.04) and (None in fonts or abs(fonts[0] - fonts[1]) <= 2.2) and beside
            if merged:
                box = min(box[0], left), min(box[1], top), max(box[2], right), max(box[3], bottom)
            else:
                number, box = number + 1, (left, top, right, bottom)
            last = r
            expected.add((*key, r["reading_order"], number))
    found = layout.merge_paragraphs(rows.drop("next", "heading", "on")).select("document_id", "page_number", "column_no", "reading_order", "paragraph_no")
    assert {tuple(r) for r in found.collect()} == expected


def test_body_font_is_the_median_of_the_document(spark):
    rows = views.chunks(spark, SMALL).where("document_id = 3")
    sizes = [r["font_size"] for r in rows.collect() if r["font_size"] is not None]
    assert {r["body_font"] for r in layout.with_body_font(rows).collect()} == {statistics.median(sizes)}


BLOCK = "document_id long, block_no int, page_number int, text string, y double, font_size double, body_font double, metadata_title string, source_name string"


def test_titles(spark):
    rows = []
    for document, meta in ((1, None), (2, "Given"), (3, "f.pdf")):
        rows += [(document, 1, 1, "1. Not this", 0.05, 30.0, 10.0, meta, "f.pdf"), (document, 2, 1, "The title", 0.1, 20.0, 10.0, meta, "f.pdf"), (document, 3, 1, "Other", 0.2, 18.0, 10.0, meta, "f.pdf"), (document, 4, 1, "Body.", 0.9, 10.0, 10.0, meta, "f.pdf")]
    rows += [(4, 1, 1, "Close", 0.1, 12.0, 10.0, None, "f.pdf"), (4, 2, 1, "Closer", 0.1, 11.0, 10.0, None, "f.pdf"), (5, 1, 2, "Page two", None, 30.0, 10.0, " ", "f.pdf")]
    found = {}
    for r in layout.titled(spark.createDataFrame(rows, BLOCK), "block_no").collect():
        found.setdefault((r["document_id"], r["title"]), set()).add(r["block_no"])
    assert found == {(1, "The title"): {1, 3, 4}, (2, "Given"): {1, 2, 3, 4}, (3, "The title"): {1, 3, 4}, (4, "f.pdf"): {1, 2}, (5, "f.pdf"): {1}}


def test_outline(spark):
    roles = ["paragraph", "subsection", "paragraph", "paragraph", "section", "paragraph", "subsection", "paragraph"]
    rows = [(1, k, 1, f"text {k}", role, "T") for k, role in enumerate(roles, 1)]
    nodes = layout.outline(spark.createDataFrame(rows, "document_id long, block_no int, page_number int, text string, role string, title string"), "block_no")
    found = {r["node_id"]: (r["parent_id"], r["ordinal"], r["level"]) for r in nodes.collect()}
    assert found == {
        "document-root": (None, 1, 0),
        "section-001": ("document-root", 1, 1),
        "node-block-001-0001": ("section-001", 1, 2),
        "section-001-subsection-002": ("section-001", 2, 2),
        "node-block-001-0002": ("section-001-subsection-002", 1, 3),
        "node-block-001-0003": ("section-001-subsection-002", 2, 3),
        "section-002": ("document-root", 2, 1),
        "node-block-001-0004": ("section-002", 1, 2),
        "section-002-subsection-002": ("section-002", 2, 2),
        "node-block-001-0005": ("section-002-subsection-002", 1, 3),
    }


def test_rematched_block_keeps_its_text_without_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "b", 0.0, 0.0, 1.0, 1.0, None, None, "c0"), (1, 2, 1, "a", 0.0, 0.0, 1.0, 1.0, None, None, "c1")], CHUNK)
    blocks = spark.createDataFrame([(1, "x", None, "old", ["c1", "c0", "c1"]), (1, "y", None, "old", ["gone"]), (1, "z", 4, None, [])], "document_id long, block_id string, page_number int, text string, chunk_ids array<string>")
    found = {r["block_id"]: (r["page_number"], r["text"], r["chunk_ids"]) for r in layout.rematched(blocks, chunks).collect()}
    assert found == {"x": (1, "b\n\na", ["c0", "c1"]), "y": (1, "old", []), "z": (4, "", [])}
