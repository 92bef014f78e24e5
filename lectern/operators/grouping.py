"""Repair of grouping output: checks of the named ids, order and defaults, paths and numbers over a document's windows, merged continuations, counts.

Outputs have one row for each window that a model has grouped: document_id, window_no, title, paragraphs (array of paragraph_id, chunk_ids, section_path,
role) and ignored_chunk_ids. Windows have document_id, window_no, chunk_id, reading_order and text, one row for each chunk. Every step is keyed by
document, so they share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as tx

PARAGRAPH = "struct<paragraph_id:string,chunk_ids:array<string>,section_path:array<string>,role:string>"
OUTPUT = f"title string, paragraphs array<{PARAGRAPH}>, ignored_chunk_ids array<string>"
WINDOW = ["document_id", "window_no"]


def parse(rows: DataFrame, json_col: str) -> DataFrame:
    """document_id, window_no and the fields of an output that is given as JSON text."""
    return rows.select(*WINDOW, F.from_json(json_col, OUTPUT).alias("o")).select(*WINDOW, "o.*")


def _trimmed(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")


def named_ids(outputs: DataFrame) -> DataFrame:
    """Every id that a window's groups or its ignore list name: document_id, window_no, item (the group's place, null in the ignore list), chunk_id."""
    groups = outputs.select(*WINDOW, F.posexplode("paragraphs").alias("item", "p")).select(*WINDOW, "item", F.explode(_trimmed(F.col("p.chunk_ids"))).alias("chunk_id"))
    ignored = outputs.select(*WINDOW, F.lit(None).cast("int").alias("item"), F.explode(_trimmed(F.col("ignored_chunk_ids"))).alias("chunk_id"))
    return groups.unionByName(ignored).distinct()


def unknown_ids(outputs: DataFrame, windows: DataFrame) -> DataFrame:
    """Ids that are named but are not in their window, in groups and in the ignore list; they make the window's output an error."""
    return named_ids(outputs).join(windows.select(*WINDOW, "chunk_id").hint("merge"), [*WINDOW, "chunk_id"], "left_anti").select(*WINDOW, "item", "chunk_id")


def without_errors(outputs: DataFrame, unknown: DataFrame) -> DataFrame:
    """Outputs of the windows that name known ids only."""
    return outputs.join(unknown.select(*WINDOW).distinct().hint("merge"), WINDOW, "left_anti")


def clean(outputs: DataFrame, windows: DataFrame) -> DataFrame:
    """Groups of each window in order of their first chunk: document_id, window_no, position (from 1), paragraph_id, chunk_ids, section_path, role.

    Ids are trimmed, distinct, and in reading order; groups without any are dropped; a blank paragraph id is numbered among the groups that are
    left; parts of paths are trimmed and blank ones left out; roles are in lower case, `body` if blank.
    """
    listed = outputs.select(*WINDOW, F.posexplode("paragraphs").alias("item", "p"))
    ids = listed.select(*WINDOW, "item", "p", F.explode(F.array_distinct(_trimmed(F.col("p.chunk_ids")))).alias("chunk_id"))
    known = ids.join(windows.select(*WINDOW, "chunk_id", "reading_order").hint("merge"), [*WINDOW, "chunk_id"])
    groups = known.groupBy(*WINDOW, "item").agg(F.first("p").alias("p"), F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id"))).alias("s"))
    given, first = Window.partitionBy(*WINDOW).orderBy("item"), Window.partitionBy(*WINDOW).orderBy(F.col("s")[0]["reading_order"], "item")
    return groups.select(
        *WINDOW,
        F.row_number().over(first).alias("position"),
        tx.block_id(F.trim(F.coalesce("p.paragraph_id", F.lit(""))), F.format_string("paragraph-%04d", F.row_number().over(given))).alias("paragraph_id"),
        F.transform("s", lambda x: x["chunk_id"]).alias("chunk_ids"),
        _trimmed(F.col("p.section_path")).alias("section_path"),
        F.coalesce(F.nullif(F.lower(F.trim("p.role")), F.lit("")), F.lit("body")).alias("role"),
    )


def ignored(outputs: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The ids of ignore lists that no group of the same window (or document, by `by`) uses, sorted: by, chunk_ids."""
    listed = outputs.select(*by, F.explode(_trimmed(F.col("ignored_chunk_ids"))).alias("chunk_id")).distinct()
    used = groups.select(*by, F.explode("chunk_ids").alias("chunk_id")).distinct()
    left = listed.join(used.hint("merge"), [*by, "chunk_id"], "left_anti")
    return left.groupBy(*by).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def numbered(groups: DataFrame) -> DataFrame:
    """Groups numbered over all windows of their document: ord, paragraph_id (`paragraph-` and the number), source_paragraph_id (what it was called), and an empty
    path taking the last one before it that is not empty."""
    order = Window.partitionBy("document_id").orderBy("window_no", "position")
    last = F.last(F.when(F.size("section_path") > 0, F.col("section_path")), ignorenulls=True).over(order)
    rows = groups.withColumn("ord", F.row_number().over(order)).withColumn("section_path", F.coalesce(last, "section_path"))
    return rows.withColumn("source_paragraph_id", F.col("paragraph_id")).withColumn("paragraph_id", F.format_string("paragraph-%04d", "ord"))


def titles(outputs: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id and title: the last window title that is not blank, else the document's own (documents: document_id, title)."""
    said = outputs.select("document_id", F.when(F.trim("title") != "", F.struct("window_no", F.trim("title").alias("t"))).alias("s")).groupBy("document_id").agg(F.max("s")["t"].alias("__title"))
    joined = documents.select("document_id", "title").join(said.hint("merge"), "document_id", "left")
    return joined.select("document_id", F.coalesce("__title", F.trim(F.coalesce("title", F.lit("")))).alias("title"))


def envelopes(windows: DataFrame, groups: DataFrame, documents: DataFrame) -> DataFrame:
    """What each window is sent with: document_id, window_no, index (from 1), count, title, previous_section_path (of the last group before it), chunk_ids.

    groups are numbered() ones; documents: document_id, title.
    """
    held = windows.groupBy(*WINDOW).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    ends = groups.groupBy(*WINDOW).agg(F.max_by("section_path", "ord").alias("__path"))
    order = Window.partitionBy("document_id").orderBy("window_no")
    rows = held.join(ends.hint("merge"), WINDOW, "left").join(documents.select("document_id", "title").hint("merge"), "document_id", "left")
    before = F.last("__path", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        *WINDOW,
        F.row_number().over(order).alias("index"),
        F.count(F.lit(1)).over(Window.partitionBy("document_id")).cast("int").alias("count"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(before, F.array().cast("array<string>")).alias("previous_section_path"),
        "chunk_ids",
    )


_PART = "array<struct<id:string,ends:int,begins:boolean>>"
_OUT = "array<struct<ord:int,no:int,ids:array<string>>>"
#: How a chunk's text ends: with a hyphen, with a sentence, otherwise; 0 for a blank one.
HYPHEN, SENTENCE, OPEN = 1, 2, 3


def _parts(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Groups with how each of their chunks begins and ends, in the order of their ids."""
    text = F.trim(F.coalesce("text", F.lit("")))
    ends = F.when(text == "", 0).when(F.endswith(text, F.lit("-")), HYPHEN).when(tx.continues(text, F.lit("a")), OPEN).otherwise(SENTENCE)
    begins = tx.continues(F.lit("a"), text)
    known = chunks.select("document_id", "chunk_id", ends.alias("ends"), begins.alias("begins"))
    ids = groups.select("document_id", "ord", "section_path", "role", F.posexplode("chunk_ids").alias("at", "chunk_id")).join(known.hint("merge"), ["document_id", "chunk_id"])
    found = F.array_sort(F.collect_list(F.struct("at", "chunk_id", "ends", "begins")))
    rows = ids.groupBy("document_id", "ord").agg(F.first("section_path").alias("path"), F.first("role").alias("role"), found.alias("s"))
    return rows.select("document_id", "ord", "path", "role", F.transform("s", lambda x: F.struct(x["chunk_id"].alias("id"), x["ends"].alias("ends"), x["begins"].alias("begins"))).cast(_PART).alias("parts"))


def merged(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered groups with sentences that go on in the next group put together: document_id, paragraph_id, source_paragraph_id, chunk_ids, section_path, role.

    Neighbours of one path and role are merged while the text of all that was merged so far goes on in the next group. Groups may share chunks: an id that is
    there already is not taken again, so the text ends where it did if the next group adds nothing. A fold over a document's groups with the ids,
    path, role and ending of the one that is open; the first group's id stays.
    """
    listed = _parts(groups, chunks).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "role", "parts"))).alias("gs"))
    none = F.lit(None)
    begin = F.struct(F.lit(0).alias("no"), F.array().cast("array<string>").alias("ids"), F.lit(0).alias("ends"), none.cast("array<string>").alias("path"), none.cast("string").alias("role"), F.array().cast(_OUT).alias("out"))
    ending = lambda parts: F.coalesce(F.try_element_at(F.filter(F.transform(parts, lambda p: p["ends"]), lambda e: e > 0), F.lit(-1)), F.lit(0))

    def step(s: Column, g: Column) -> Column:
        first = F.get(F.filter(g["parts"], lambda p: p["ends"] > 0), 0)
        goes_on = (s["ends"] == HYPHEN) | ((s["ends"] == OPEN) & first["begins"])
        joins = (s["no"] > 0) & s["path"].eqNullSafe(g["path"]) & s["role"].eqNullSafe(g["role"]) & F.coalesce(first.isNotNull() & goes_on, F.lit(False))
        new = F.when(joins, F.filter(g["parts"], lambda p: ~F.array_contains(s["ids"], p["id"]))).otherwise(g["parts"])

        def moved(x: Column) -> Column:
            ids = F.transform(x["new"], lambda p: p["id"])
            no = s["no"] + F.when(x["joins"], 0).otherwise(1)
            tail = ending(x["new"])
            return F.struct(
                no.alias("no"),
                F.when(x["joins"], F.concat(s["ids"], ids)).otherwise(ids).alias("ids"),
                F.when(x["joins"] & (tail == 0), s["ends"]).otherwise(tail).alias("ends"),
                g["path"].alias("path"),
                g["role"].alias("role"),
                F.concat(s["out"], F.array(F.struct(g["ord"].cast("int").alias("ord"), no.alias("no"), ids.alias("ids")))).alias("out"),
            )

        # an array of one element keeps the decision from being worked out again
        return F.get(F.transform(F.array(F.struct(joins.alias("joins"), new.alias("new"))), moved), 0)

    folded = listed.select("document_id", F.explode(F.aggregate("gs", begin, step)["out"]).alias("o")).select("document_id", "o.*")
    whole = folded.groupBy("document_id", "no").agg(F.min("ord").alias("ord"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ids"))), lambda x: x["ids"])).alias("chunk_ids"))
    own = groups.select("document_id", "ord", "paragraph_id", "source_paragraph_id", "section_path", "role")
    return whole.join(own.hint("merge"), ["document_id", "ord"]).select("document_id", "paragraph_id", "source_paragraph_id", "chunk_ids", "section_path", "role")


def metrics(paragraphs: DataFrame, left_out: DataFrame, windows: DataFrame) -> DataFrame:
    """document_id, paragraph_count, ignored_chunk_count and semantic_window_count. left_out: ignored() by document."""
    counted = windows.groupBy("document_id").agg(F.countDistinct("window_no").alias("semantic_window_count"))
    made = paragraphs.groupBy("document_id").agg(F.count(F.lit(1)).alias("paragraph_count"))
    ignored_ = left_out.select("document_id", F.size("chunk_ids").cast("bigint").alias("ignored_chunk_count"))
    rows = counted.join(made.hint("merge"), "document_id", "left").join(ignored_.hint("merge"), "document_id", "left")
    return rows.select("document_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("paragraph_count", "ignored_chunk_count", "semantic_window_count")))
