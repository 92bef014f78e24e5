"""Chunks to paragraphs to an outline. One key (the document) runs through all of it, so one shuffle serves the windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import boxes
from lectern.functions import text as tx

DEFAULT_FONT = 12.0


def body_font(chunks: DataFrame) -> DataFrame:
    """Median of a document's known font sizes, 12 without one."""
    return chunks.groupBy("document_id").agg(F.coalesce(F.median("font_size"), F.lit(DEFAULT_FONT)).alias("body_font"))


def with_body_font(chunks: DataFrame) -> DataFrame:
    """The chunks with their document's body_font; a window on the document's key, which later windows share."""
    return chunks.withColumn("body_font", F.coalesce(F.median("font_size").over(Window.partitionBy("document_id")), F.lit(DEFAULT_FONT)))


def group_box(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding boxes of groups of boxes."""
    box = rows.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    return box.select(*keys, "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))


def reading_blocks(chunks: DataFrame) -> DataFrame:
    """block_no of each chunk: a block goes on over chunks of one page while the sentence does."""
    order = Window.partitionBy("document_id").orderBy("reading_order")
    # a text is looked at once, in its own row; the next row needs no copy of it
    told = chunks.withColumn("__end", tx.sentence_end(F.col("text"))).withColumn("__start", tx.sentence_start(F.col("text")))
    same = (F.lag("page_number").over(order) == F.col("page_number")) & tx.goes_on(F.lag("__end").over(order), F.col("__start"))
    opened = told.withColumn("opens", F.when(same, 0).otherwise(1))
    return opened.withColumn("block_no", F.sum("opens").over(order).cast("int")).drop("opens", "__end", "__start")


def assemble(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of grouped chunks: page, text, median font, bold, chunk ids and box, in reading order; body_font where the rows have it."""
    kept = [F.first("body_font").alias("body_font")] if "body_font" in rows.columns else []
    ordered = F.sort_array(F.collect_list(F.struct("reading_order", F.trim("text").alias("text"), "chunk_id")))
    blocks = rows.groupBy(*keys).agg(
        F.min("page_number").alias("page_number"),
        ordered.alias("parts"),
        F.coalesce(F.median("font_size"), F.lit(DEFAULT_FONT)).alias("font_size"),
        F.bool_or("is_bold").alias("is_bold"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("bottom"),
        *kept,
    )
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " ")
    return blocks.select(
        *keys,
        "page_number",
        text.alias("text"),
        F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"),
        "font_size",
        "is_bold",
        "x",
        "y",
        (F.col("right") - F.col("x")).alias("width"),
        (F.col("bottom") - F.col("y")).alias("height"),
        *(["body_font"] if kept else []),
    )


def role(text: Column, font: Column, bold: Column, body: Column, level: Column | None = None, typed: Column | None = None) -> Column:
    """section, subsection or paragraph."""
    chain = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "paragraph")
    if level is not None:
        chain = chain.when(level <= 1, "section").when(level.isNotNull(), "subsection")
    if typed is not None:
        chain = chain.when(typed == "heading", "section")
    by_number = tx.once(tx.numbered_depth(text), lambda depth: F.when(depth <= 1, "section").when(depth > 1, "subsection"))
    loud = F.when(font >= body * 1.30, "section").when((font >= body * 1.12) | bold, "subsection")
    # whether a text looks like a heading is asked of loud ones only
    return F.coalesce(chain, by_number, F.when(loud.isNotNull() & tx.heading_like(text), loud), F.lit("paragraph"))


def section_paths(rows: DataFrame, order_col: str) -> DataFrame:
    """section_path of each row: the section (`Body` before any) and the subsection carried forward."""
    order = Window.partitionBy("document_id").orderBy(order_col)
    rows = rows.withColumn("__section_no", F.count_if(F.col("role") == "section").over(order))
    rows = rows.withColumn("__section", F.last(F.when(F.col("role") == "section", F.col("text")), ignorenulls=True).over(order))
    within = Window.partitionBy("document_id", "__section_no").orderBy(order_col)
    rows = rows.withColumn("__sub", F.last(F.when(F.col("role") == "subsection", F.col("text")), ignorenulls=True).over(within))
    path = F.filter(F.array(F.coalesce("__section", F.lit("Body")), "__sub"), lambda p: p.isNotNull())
    return rows.withColumn("section_path", path).drop("__section_no", "__section", "__sub")


def page_numbered(rows: DataFrame, order_col: str, prefix: str = "block") -> DataFrame:
    """Ids like block-001-0001, counted per page."""
    order = Window.partitionBy("document_id", "page_number").orderBy(order_col)
    return rows.withColumn("block_id", F.format_string(f"{prefix}-%03d-%04d", F.col("page_number"), F.row_number().over(order)))


def titled(blocks: DataFrame, order_col: str) -> DataFrame:
    """The content blocks with their document's title.

    A metadata title other than the source's name wins, and nothing is taken out. Else the largest candidate near the top of page 1, if
    it stands out from the body and the next, becomes the title and leaves the content. Else the source's name is it. blocks have
    body_font, metadata_title and source_name.
    """
    near = F.coalesce((F.col("page_number") == 1) & (F.col("y") <= 0.30) & (F.length("text") <= 220) & ~tx.numbered(F.col("text")), F.lit(False))
    size = F.coalesce("font_size", F.lit(0.0))
    document = Window.partitionBy("document_id")
    order = document.orderBy(F.col("__near").desc(), F.col("__size").desc(), "y", order_col)
    ranked = blocks.withColumn("__near", near).withColumn("__size", size)
    ranked = ranked.withColumn("__candidate", F.when(F.col("__near"), F.col("__size")))
    ranked = ranked.withColumn("__rank", F.row_number().over(order)).withColumn("__next", F.lead("__candidate").over(order))
    best = F.col("__near") & (F.col("__rank") == 1) & (size >= F.greatest(F.col("body_font") * 1.2, F.coalesce("__next", F.lit(0.0)) + 1.5))
    named = F.nullif(F.trim(F.coalesce("metadata_title", F.lit(""))), F.lit(""))
    named = F.when(named != F.col("source_name"), named)
    ranked = ranked.withColumn("__named", named).withColumn("__best", best & named.isNull())
    inferred = F.max(F.when(F.col("__best"), F.col("text"))).over(document)
    rows = ranked.withColumn("title", F.coalesce("__named", inferred, "source_name"))
    return rows.where(~F.col("__best")).drop("__near", "__size", "__candidate", "__rank", "__next", "__named", "__best")


def outline(rows: DataFrame, order_col: str) -> DataFrame:
    """The outline as an adjacency table: document_id, node_id, parent_id, ordinal, level, node_type, title, page_number, block_id.

    The document (0) has sections (1), these have subsections (2) and paragraphs, which stand below the current subsection (3) or the section (2). What
    comes before any section stands in a section `Body`. rows: document_id, title, role, text, page_number.
    """
    document = Window.partitionBy("document_id")
    order = document.orderBy(order_col)
    is_section, is_sub = F.col("role") == "section", F.col("role") == "subsection"
    paragraph = ~is_section & ~is_sub
    # only what is shown of a text goes through the windows
    rows = rows.select("document_id", "title", "role", F.when(is_section | is_sub, F.col("text")).otherwise(tx.short_title(F.col("text"))).alias("__shown"), "page_number", order_col)
    numbered = F.row_number().over(Window.partitionBy("document_id", "page_number", "__paragraph").orderBy(order_col))
    rows = rows.withColumn("__paragraph", paragraph).withColumn("block_id", F.when(F.col("__paragraph"), F.format_string("block-%03d-%04d", F.col("page_number"), numbered)))
    rows = rows.withColumn("__no", F.count_if(is_section).over(order)).withColumn("__body", F.min(F.when(is_section, F.col(order_col))).over(document)).withColumn("__first", F.min(order_col).over(document))
    default = F.coalesce(F.col("__body") > F.col("__first"), F.lit(True))
    rows = rows.withColumn("__section", F.col("__no") + F.when(default, 1).otherwise(0)).withColumn("__section_id", F.format_string("section-%03d", "__section"))
    within = Window.partitionBy("document_id", "__section").orderBy(order_col)
    rows = rows.withColumn("__subs", F.count_if(is_sub).over(within))
    direct = is_sub | (~is_section & (F.col("__subs") == 0))
    rows = rows.withColumn("__direct", F.count_if(direct).over(within))
    rows = rows.withColumn("__sub_id", F.last(F.when(is_sub, F.format_string("%s-subsection-%03d", "__section_id", "__direct")), ignorenulls=True).over(within))
    below = F.row_number().over(Window.partitionBy("document_id", "__section", "__subs").orderBy(order_col)) - 1
    rows = rows.withColumn("__below", below)
    own = F.struct(
        F.when(is_section, F.col("__section_id")).when(is_sub, F.col("__sub_id")).otherwise(F.concat(F.lit("node-"), "block_id")).alias("node_id"),
        F.when(is_section, F.lit("document-root")).when(is_sub, F.col("__section_id")).otherwise(F.coalesce("__sub_id", "__section_id")).alias("parent_id"),
        F.when(is_section, F.col("__section")).when(direct, F.col("__direct")).otherwise(F.col("__below")).cast("long").alias("ordinal"),
        F.when(is_section, 1).when(is_sub, 2).when(F.col("__sub_id").isNull(), 2).otherwise(3).alias("level"),
        F.when(is_section | is_sub, F.col("role")).otherwise("paragraph").alias("node_type"),
        F.col("__shown").alias("title"),
        F.col("page_number").alias("page_number"),
        F.col("block_id").alias("block_id"),
    )
    missing = F.lit(None).cast("string")
    root = F.struct(F.lit("document-root").alias("node_id"), missing.alias("parent_id"), F.lit(1).cast("long").alias("ordinal"), F.lit(0).alias("level"), F.lit("document").alias("node_type"), F.col("title").alias("title"), F.lit(None).cast("int").alias("page_number"), missing.alias("block_id"))
    body = F.struct(F.lit("section-001").alias("node_id"), F.lit("document-root").alias("parent_id"), F.lit(1).cast("long").alias("ordinal"), F.lit(1).alias("level"), F.lit("section").alias("node_type"), F.lit("Body").alias("title"), F.lit(None).cast("int").alias("page_number"), missing.alias("block_id"))
    begins = F.col(order_col) == F.col("__first")
    nodes = F.when(begins & default, F.array(root, body, own)).when(begins, F.array(root, own)).otherwise(F.array(own))
    return rows.select("document_id", F.explode(nodes).alias("n")).select("document_id", "n.*")


def grouped_blocks(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks of groups of chunk ids: ids that the document does not have are dropped, groups left without any too; a path without a
    non-blank part is `Body`; the group's id, made safe, names the block, else its page and number.

    groups: document_id, group_no (from 1), paragraph_id, section_path, chunk_ids; text and ids keep the group's order.
    """
    named = groups.select("document_id", "group_no", "paragraph_id", "section_path", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    known = named.join(chunks.select("document_id", "chunk_id", "page_number", "text").hint("merge"), ["document_id", "chunk_id"])
    parts = known.groupBy("document_id", "group_no").agg(F.first("paragraph_id").alias("paragraph_id"), F.first("section_path").alias("path"), F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "page_number", F.trim("text").alias("t")))).alias("p"))
    page = F.element_at("p", 1)["page_number"]
    path = F.filter(F.coalesce("path", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return parts.select(
        "document_id",
        "group_no",
        tx.block_id(F.coalesce("paragraph_id", F.lit("")), F.format_string("block-%03d-%04d", page, F.col("group_no"))).alias("block_id"),
        page.alias("page_number"),
        F.when(F.size(path) > 0, path).otherwise(F.array(F.lit("Body"))).alias("section_path"),
        F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), " ").alias("text"),
        F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"),
    )


def normalised_documents(documents: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, page_count (its own if it is a number, else the number of its pages), paragraph_count. documents: document_id, page_count (a string)."""
    pages = chunks.groupBy("document_id").agg(F.countDistinct("page_number").cast("int").alias("__pages"))
    counts = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("__blocks"))
    rows = documents.join(pages.hint("merge"), "document_id", "left").join(counts.hint("merge"), "document_id", "left")
    return rows.select("document_id", F.coalesce(tx.to_int(F.col("page_count")), "__pages", F.lit(0)).alias("page_count"), F.coalesce("__blocks", F.lit(0)).alias("paragraph_count"))


def normalised_blocks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks with an id (`paragraph-0001` by place), a page (their own, else the first chunk's, else 1), no blank chunk ids and no null text.

    blocks: document_id, pos, block_id, page_number (a string or null), chunk_ids, text.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    ids = F.filter(F.coalesce("chunk_ids", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    rows = blocks.withColumn("__no", F.row_number().over(order)).withColumn("chunk_ids", ids).withColumn("__first", F.try_element_at("chunk_ids", F.lit(1)))
    pages = chunks.select(F.col("document_id").alias("__doc"), F.col("chunk_id").alias("__chunk"), F.col("page_number").alias("__page"))
    rows = rows.join(pages.hint("merge"), (F.col("document_id") == F.col("__doc")) & (F.col("__first") == F.col("__chunk")), "left")
    return rows.select(
        "document_id",
        "pos",
        F.trim(F.coalesce(F.nullif("block_id", F.lit("")), F.format_string("paragraph-%04d", "__no"))).alias("block_id"),
        F.coalesce(tx.to_int(F.col("page_number")), "__page", F.lit(1)).alias("page_number"),
        "chunk_ids",
        F.coalesce("text", F.lit("")).alias("text"),
    )


def placed_ids(blocks: Column) -> Column:
    """Saved blocks named by their place, which counts entries that are no blocks (null) too; those are left out."""
    placed = F.transform(blocks, lambda b, i: F.struct(F.concat(F.lit("paragraph-"), (i + 1).cast("string")).alias("block_id"), b.alias("block")))
    return F.filter(placed, lambda p: p["block"].isNotNull())


def rematched(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks after their chunk ids were changed: ids in reading order (unknown ones dropped), the page of the first, the chunks'
    texts joined by a blank line, or the old text and page without any.

    blocks: document_id, block_id, page_number, text, chunk_ids.
    """
    ids = blocks.select("document_id", "block_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    known = ids.join(chunks.select("document_id", "chunk_id", "reading_order", F.col("page_number").alias("p"), F.col("text").alias("t")).hint("merge"), ["document_id", "chunk_id"])
    found = known.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id", "p", "t"))).alias("s"))
    joined = blocks.join(found.hint("merge"), ["document_id", "block_id"], "left")
    text = F.array_join(F.filter(F.transform("s", lambda x: x["t"]), lambda t: t != ""), "\n\n")
    return joined.select(
        "document_id",
        "block_id",
        F.coalesce(F.element_at("s", 1)["p"], "page_number", F.lit(1)).alias("page_number"),
        F.coalesce(F.nullif(text, F.lit("")), "text", F.lit("")).alias("text"),
        F.coalesce(F.transform("s", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("chunk_ids"),
    )


def selection_summaries(selections: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, selection_id, summary: how many ids are selected, on which pages (distinct, in reading order), the first four ids.

    selections: document_id, selection_id, chunk_ids; ids that the document does not have count but are on no page.
    """
    ids = selections.select("document_id", "selection_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    known = ids.join(chunks.select("document_id", "chunk_id", "reading_order", "page_number").hint("merge"), ["document_id", "chunk_id"])
    pages = known.groupBy("document_id", "selection_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "page_number"))), lambda s: s["page_number"])).alias("pages"))
    joined = selections.join(pages.hint("merge"), ["document_id", "selection_id"], "left")
    size = F.size("chunk_ids")
    where = F.coalesce(F.concat(F.lit(" on p"), F.array_join("pages", ", p")), F.lit(""))
    more = F.when(size > 4, F.concat(F.lit(", +"), (size - 4).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(size.cast("string"), F.lit(" selected"), where, F.lit(": "), F.array_join(F.slice("chunk_ids", 1, 4), ", "), more)
    return joined.select("document_id", "selection_id", F.when(size > 0, text).otherwise("No chunks selected.").alias("summary"))


def body_only(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected chunks (document_id, reading_order) page by page: document_id, page_number, chunk_ids, error. A page without any stays with an empty
    list; the pages of a document of which nothing is selected say so in error."""
    marked = chunks.join(selected.select("document_id", "reading_order").distinct().withColumn("__in", F.lit(True)).hint("merge"), ["document_id", "reading_order"], "left")
    kept = F.collect_list(F.when(F.col("__in"), F.struct("reading_order", "chunk_id")))
    paged = marked.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(kept), lambda s: s["chunk_id"]).alias("chunk_ids"))
    most = F.max(F.size("chunk_ids")).over(Window.partitionBy("document_id"))
    return paged.withColumn("error", F.when(most == 0, "nothing of the body was found"))


def path_nodes(rows: DataFrame, order_col: str) -> DataFrame:
    """Outline nodes of section paths: one for each distinct prefix, numbered in order of first sight."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda k: F.slice("section_path", 1, k))
    seen = rows.select("document_id", order_col, F.posexplode(prefixes).alias("depth", "path")).groupBy("document_id", "path").agg(F.min(F.struct(F.col(order_col).alias("at"), "depth")).alias("first"))
    order = Window.partitionBy("document_id").orderBy("first.at", "first.depth")
    nodes = seen.select("document_id", "path", (F.col("first.depth") + 1).alias("level"), F.row_number().over(order).alias("node_no"))
    kind = F.when(F.col("level") == 1, "section").otherwise("subsection")
    return nodes.select("document_id", F.format_string("%s-%03d", kind, F.col("node_no")).alias("node_id"), F.array_join("path", " > ").alias("path"), "level", F.element_at("path", -1).alias("title"), kind.alias("node_type"))


def chunk_blocks(chunks: DataFrame, blocks: DataFrame, order_col: str) -> DataFrame:
    """Each chunk with the ids of its blocks in block order; [] for unmapped chunks."""
    held = blocks.select("document_id", F.col(order_col).alias("__at"), "block_id", F.explode("chunk_ids").alias("chunk_id"))
    held = held.groupBy("document_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "block_id"))), lambda s: s["block_id"]).alias("block_ids"))
    joined = chunks.join(held.hint("merge"), ["document_id", "chunk_id"], "left")
    return joined.withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))


def columns_of_page(chunks: DataFrame) -> DataFrame:
    """column_no of each chunk. A chunk joins the first column whose box, grown by all it has, overlaps it or begins or is centred alike.

    The rule depends on what was joined before: a fold over a page's chunks from top to bottom, inside the JVM.
    """
    placed = F.struct("y", "x", "reading_order", (F.col("x") + F.col("width")).alias("right"), F.struct(*chunks.columns).alias("row"))
    pages = chunks.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(placed)).alias("cs"))
    start = F.struct(F.expr("cast(array() as array<struct<l:double,r:double>>)").alias("cols"), F.expr("cast(array() as array<int>)").alias("out"))

    def joins(col: Column, c: Column) -> Column:
        shared = F.greatest(F.lit(0.0), F.least(col["r"], c["right"]) - F.greatest(col["l"], c["x"]))
        narrow = F.greatest(F.least(col["r"] - col["l"], c["right"] - c["x"]), F.lit(1e-6))
        centre = F.abs((col["l"] + col["r"]) / 2 - (c["x"] + c["right"]) / 2)
        return (shared / narrow >= 0.35) | (centre <= 0.08) | (F.abs(col["l"] - c["x"]) <= 0.05)

    def step(s: Column, c: Column) -> Column:
        def grow(at: Column) -> Column:
            wider = lambda col: F.struct(F.least(col["l"], c["x"]).alias("l"), F.greatest(col["r"], c["right"]).alias("r"))
            grown = F.transform(s["cols"], lambda col, i: F.when(i + 1 == at, wider(col)).otherwise(col))
            opened = F.concat(s["cols"], F.array(F.struct(c["x"].alias("l"), c["right"].alias("r"))))
            number = F.when(at > 0, at).otherwise(F.size(s["cols"]) + 1)
            return F.struct(F.when(at > 0, grown).otherwise(opened).alias("cols"), F.concat(s["out"], F.array(number)).alias("out"))

        # an array of one element keeps the place from being looked up for each column
        at = F.array_position(F.transform(s["cols"], lambda col: joins(col, c)), F.lit(True)).cast("int")
        return F.get(F.transform(F.array(at), grow), 0)

    folded = pages.select("cs", F.aggregate("cs", start, step).alias("f"))
    left = lambda k: F.element_at("f.cols", k)["l"]
    before = lambda k: F.filter("f.cols", lambda col, i: (col["l"] < left(k)) | ((col["l"] == left(k)) & (i + 1 < k)))
    numbers = F.transform("f.out", lambda k: F.size(before(k)))
    rows = folded.select(F.explode(F.arrays_zip(F.col("cs.row").alias("row"), numbers.alias("column_no"))).alias("z"))
    return rows.select("z.row.*", "z.column_no")


def merge_paragraphs(chunks: DataFrame) -> DataFrame:
    """paragraph_no of each chunk within its page and column.

    A chunk extends the paragraph while neither it nor the last chunk is a heading, the sentence goes on, and box and font fit. The
    box is that of all the paragraph has, so the rule depends on what was merged before: a fold like that of columns_of_page, which
    keeps the places where paragraphs begin. chunks have column_no and body_font.
    """
    heading = tx.heading_chunk(F.col("text"), F.lit(None).cast("string"), F.col("is_bold"), F.col("font_size"), F.col("body_font"))
    placed = F.struct(
        "y",
        "x",
        "reading_order",
        (F.col("x") + F.col("width")).alias("right"),
        (F.col("y") + F.col("height")).alias("bottom"),
        heading.alias("heading"),
        F.trim("text").alias("t"),
        F.col("font_size").alias("font"),
        F.struct(*chunks.columns).alias("row"),
    )
    columns = chunks.groupBy("document_id", "page_number", "column_no").agg(F.sort_array(F.collect_list(placed)).alias("cs"))
    nothing = {"l": 0.0, "t": 0.0, "r": 0.0, "b": 0.0}
    start = F.struct(
        F.lit(0).alias("at"),
        *(F.lit(v).alias(k) for k, v in nothing.items()),
        F.lit(True).alias("heading"),
        F.lit(None).cast("double").alias("font"),
        F.lit("").alias("tail"),
        F.expr("cast(array() as array<int>)").alias("out"),
    )

    def fits(s: Column, c: Column) -> Column:
        gap = F.greatest(c["y"] - s["b"], F.lit(0.0))
        room = F.greatest(2 * (s["b"] - s["t"]), 2 * (c["bottom"] - c["y"]), F.lit(0.04))
        shared = F.greatest(F.lit(0.0), F.least(s["r"], c["right"]) - F.greatest(s["l"], c["x"])) / F.greatest(F.least(s["r"] - s["l"], c["right"] - c["x"]), F.lit(1e-6))
        near = (shared >= 0.25) | (F.abs(c["x"] - s["l"]) <= 0.05) | (F.abs((c["x"] + c["right"] - s["l"] - s["r"]) / 2) <= 0.06)
        return (gap <= room) & (F.coalesce(F.abs(s["font"] - c["font"]), F.lit(0.0)) <= 2.2) & near

    def step(s: Column, c: Column) -> Column:
        on = ~s["heading"] & ~c["heading"] & tx.continues(s["tail"], c["t"]) & fits(s, c)
        at = s["at"] + 1
        last = [c["heading"].alias("heading"), c["font"].alias("font"), c["t"].alias("tail")]
        grown = [F.least(s["l"], c["x"]).alias("l"), F.least(s["t"], c["y"]).alias("t"), F.greatest(s["r"], c["right"]).alias("r"), F.greatest(s["b"], c["bottom"]).alias("b")]
        own = [c["x"].alias("l"), c["y"].alias("t"), c["right"].alias("r"), c["bottom"].alias("b")]
        # one choice for all fields: whether the chunk fits is worked out once
        opened = F.struct(at.alias("at"), *own, *last, F.concat(s["out"], F.array(at)).alias("out"))
        return F.when(on, F.struct(at.alias("at"), *grown, *last, s["out"].alias("out"))).otherwise(opened)

    folded = columns.select("cs", F.aggregate("cs", start, step)["out"].alias("begins"))
    return runs_of(folded, "cs", "begins", "paragraph_no")


def runs_of(rows: DataFrame, items: str, begins: str, number: str) -> DataFrame:
    """One row for each item's `row` with the number (from 1) of its run; runs begin at the given places (from 1, ascending)."""
    ends = F.concat(F.slice(begins, 2, 2**30), F.array(F.size(items) + 1))
    spans = F.arrays_zip(F.col(begins).alias("a"), ends.alias("b"))
    runs = rows.select(items, F.posexplode(spans).alias("__run", "__span")).select((F.col("__run") + 1).alias(number), F.explode(F.slice(items, F.col("__span.a"), F.col("__span.b") - F.col("__span.a"))).alias("__item"))
    return runs.select("__item.row.*", number)


def parser_label(grouped: Column, presegmented: Column) -> Column:
    """How a document's paragraphs came about."""
    return F.when(grouped & presegmented, "presegmented-grouped").when(grouped, "grouped").when(presegmented, "presegmented").otherwise("layout")


def representative_font(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, font_size (the median size of the spans, null without any) and font_name (the first that is not blank, trimmed, in span order)."""
    named = F.when(F.trim("font_name") != "", F.col(order))
    return spans.groupBy(*keys).agg(F.median("font_size").alias("font_size"), F.min_by(F.trim("font_name"), named).alias("font_name"))


def overlaps(chunks: DataFrame) -> DataFrame:
    """Each chunk (but a document's first) with the horizontal overlap ratio to the one before it."""
    order = Window.partitionBy("document_id").orderBy("reading_order")
    rows = chunks.withColumn("__x", F.lag("x").over(order)).withColumn("__w", F.lag("width").over(order)).where("__x IS NOT NULL")
    return rows.select("document_id", "reading_order", F.round(boxes.overlap_ratio(F.col("__x"), F.col("__w"), F.col("x"), F.col("width")), 6).alias("overlap"))


def in_reading_order(chunks: DataFrame) -> DataFrame:
    """n of each chunk, from 0: by page number, then the provider's order in the page; never by geometry."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    return chunks.withColumn("n", (F.row_number().over(order) - 1).cast("bigint"))
