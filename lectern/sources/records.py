"""Nested page and item records to chunk rows, and file listings to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import boxes
from lectern.functions import text as tx


def bold(spans: Column) -> Column:
    """True if any span is bold, false if there are spans, null without any."""
    return F.when(F.size(spans) > 0, F.exists(spans, lambda s: F.coalesce(s["bold"], F.lit(False))))


def named_bold(kind: Column, font: Column) -> Column:
    """Whether an element is bold by its type or its font's name."""
    return (F.coalesce(kind, F.lit("")) == "heading") | F.contains(F.lower(F.coalesce(font, F.lit(""))), F.lit("bold"))


def span_blocks(pages: DataFrame) -> DataFrame:
    """Chunks of pages: text blocks (type 0) with text and a box of positive size, numbered per page from 1.

    pages: document_id, page_number, page_width, page_height, blocks (array of type, x0, y0, x1, y1, lines: array of spans: array of text, size, bold).
    """
    rows = pages.select("document_id", "page_number", "page_width", "page_height", F.posexplode("blocks").alias("at", "b"))
    spans = F.flatten(F.transform("b.lines", lambda line: line["spans"]))
    lines = F.transform("b.lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))
    sizes = F.array_sort(F.filter(F.transform(spans, lambda s: s["size"]), lambda v: v > 0))
    middle = (F.try_element_at(sizes, F.floor((F.size(sizes) + 1) / 2).cast("int")) + F.try_element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1)) / 2
    width, height = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    rows = rows.withColumn("text", tx.join_lines(lines)).where((F.col("b.type") == 0) & (F.col("text") != "") & (width > 0) & (height > 0))
    order = Window.partitionBy("document_id", "page_number").orderBy("at")
    return rows.select(
        "document_id",
        "page_number",
        F.format_string("chunk-%03d-%04d", "page_number", F.row_number().over(order)).alias("chunk_id"),
        "text",
        boxes.clamp(F.col("b.x0") / F.col("page_width")).alias("x"),
        boxes.clamp(F.col("b.y0") / F.col("page_height")).alias("y"),
        boxes.clamp(width / F.col("page_width")).alias("width"),
        boxes.clamp(height / F.col("page_height")).alias("height"),
        F.when(F.size(sizes) > 0, middle).alias("font_size"),
        bold(spans).alias("is_bold"),
    )


def page_items(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chunks of items that stand on several pages: one for each page, with the whole text and the box of its parts there.

    items: document_id, item_no, text, prov (array of page_number, x0, y0, x1, y1, origin at the bottom left); sizes: document_id,
    page_number, page_width, page_height. Blank items are left out; chunks are numbered per page in item order.
    """
    parts = items.select("document_id", "item_no", tx.collapse(F.col("text")).alias("text"), F.explode("prov").alias("p")).where("text <> ''")
    ends = {"x0": F.min("p.x0"), "y0": F.min("p.y0"), "x1": F.max("p.x1"), "y1": F.max("p.y1")}
    merged = parts.groupBy("document_id", F.col("p.page_number").alias("page_number"), "item_no").agg(F.first("text").alias("text"), *(c.alias(n) for n, c in ends.items()))
    joined = merged.join(sizes.hint("merge"), ["document_id", "page_number"])
    order = Window.partitionBy("document_id", "page_number").orderBy("item_no")
    return joined.select(
        "document_id",
        "page_number",
        F.format_string("item-%03d-%04d", "page_number", F.row_number().over(order)).alias("chunk_id"),
        "text",
        boxes.clamp(F.col("x0") / F.col("page_width")).alias("x"),
        boxes.clamp(1 - F.col("y1") / F.col("page_height")).alias("y"),
        boxes.clamp((F.col("x1") - F.col("x0")) / F.col("page_width")).alias("width"),
        boxes.clamp((F.col("y1") - F.col("y0")) / F.col("page_height")).alias("height"),
    )


def sources(files: DataFrame, path_col: str = "path", selected: str | None = None) -> DataFrame:
    """document_id and file: folders that hold a source file, `source.pdf` or else the first `*.pdf` by name; one may be selected."""
    folder, name = F.regexp_extract(path_col, "([^/]+)/[^/]+$", 1), F.regexp_extract(path_col, "([^/]+)$", 1)
    found = files.select(folder.alias("document_id"), name.alias("file")).where((F.col("document_id") != "") & F.col("file").endswith(".pdf"))
    best = found.groupBy("document_id").agg(F.min(F.struct((F.col("file") != "source.pdf").alias("other"), "file")).alias("best")).select("document_id", "best.file")
    return best if selected is None else best.where(F.col("document_id") == selected)


def list_files(spark, folder: str) -> DataFrame:
    """path and length of the files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def list_or_empty(json: Column) -> Column:
    """A JSON list as an array of JSON texts, an empty one for anything else."""
    return F.coalesce(F.transform(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), lambda v: F.to_json(v)), F.array().cast("array<string>"))


def edited_blocks(base: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Blocks of documents with saved edits: the edit's rows, in its order, a field it lacks taken from the block of the same id; no
    representations means an empty list. Documents without any edit keep their blocks."""
    changed = edits.select(keys[0]).distinct()
    joined = edits.join(base.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields)).hint("merge"), keys, "left")
    merged = joined.select(*keys, "pos", *(F.coalesce(f, f"__{f}").alias(f) for f in fields))
    if "representations" in fields:
        merged = merged.withColumn("representations", F.coalesce("representations", F.array().cast(base.schema["representations"].dataType)))
    kept = base.join(changed.hint("merge"), keys[0], "left_anti").select(*keys, "pos", *fields)
    return merged.unionByName(kept)


def replaced_pages(base: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Saved pages take the place of all of a document's pages."""
    return saved.unionByName(base.join(saved.select(key).distinct().hint("merge"), key, "left_anti"))


def exportable(exams: DataFrame, documents: DataFrame, files: DataFrame, most: int = 25 * 1024 * 1024) -> DataFrame:
    """document_id and error (null if it can be exported) of the distinct documents of enabled exams."""
    wanted = exams.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("document_id", F.lit("")) != "")).select("document_id").distinct()
    there = documents.select("document_id").distinct().withColumn("__doc", F.lit(True))
    sized = files.groupBy("document_id").agg(F.max("length").alias("__length"))
    joined = wanted.join(there.hint("merge"), "document_id", "left").join(sized.hint("shuffle_hash"), "document_id", "left")
    missing = F.col("__doc").isNull() | F.col("__length").isNull()
    return joined.select("document_id", F.when(missing, "missing").when(F.col("__length") > most, "too large").alias("error"))


def latest_documents(uploads: DataFrame) -> DataFrame:
    """One row for each content: document_id, created_at (the first) and source_name (the latest). uploads: document_id, source_name, uploaded_at."""
    return uploads.groupBy("document_id").agg(F.min("uploaded_at").alias("created_at"), F.max_by("source_name", "uploaded_at").alias("source_name"))


def latest_of_provider(updates: DataFrame) -> DataFrame:
    """The last update of each document and provider; other providers' stay. updates: document_id, provider, pos and whatever an update says."""
    others = [c for c in updates.columns if c not in ("document_id", "provider")]
    return updates.groupBy("document_id", "provider").agg(F.max_by(F.struct(*others), "pos").alias("u")).select("document_id", "provider", "u.*")


def catalogue(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of documents and files side by side: id, has_document, has_pdf, title (the document's, else the file's name, else the id). documents: id, title; files: id,
    source_name."""
    joined = documents.select("id", "title", F.lit(True).alias("__d")).join(files.select("id", "source_name", F.lit(True).alias("__p")).hint("merge"), "id", "full_outer")
    return joined.select("id", F.col("__d").isNotNull().alias("has_document"), F.col("__p").isNotNull().alias("has_pdf"), F.coalesce("title", "source_name", F.col("id").cast("string")).alias("title"))
