"""Bounded windows over a document's chunks, and repair of grouping output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as tx
from lectern.operators.layout import runs_of

SIZE, CHARS, LEAST_CHARS = 12, 6000, 1000


def pack_windows(chunks: DataFrame, size: int = SIZE, chars: int = CHARS) -> DataFrame:
    """window_no of each chunk. The state resets with each window, so it is a fold over the document's chunks, inside the JVM, that keeps
    the places where windows begin."""
    most = max(chars, LEAST_CHARS)
    row = F.struct("document_id", "reading_order", F.length("text").alias("n_chars"))
    listed = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "page_number", F.length("text").alias("n"), row.alias("row")))).alias("cs"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("c"), F.lit(0).alias("p"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        full = (s["k"] == 0) | (s["k"] >= size) | (s["c"] + c["n"] > most) | ((s["p"] != c["page_number"]) & (s["k"] >= size // 2))
        at = s["at"] + 1
        return F.struct(
            at.alias("at"),
            F.when(full, 1).otherwise(s["k"] + 1).alias("k"),
            F.when(full, c["n"]).otherwise(s["c"] + c["n"]).alias("c"),
            c["page_number"].alias("p"),
            F.when(full, F.concat(s["out"], F.array(at))).otherwise(s["out"]).alias("out"),
        )

    folded = listed.select("cs", F.aggregate("cs", start, step)["out"].alias("begins"))
    found = runs_of(folded, "cs", "begins", "window_no")
    return found.select("document_id", "reading_order", (F.col("window_no") - 1).alias("window_no"), "n_chars")


def envelope(windows: DataFrame) -> DataFrame:
    """One row for each window: its size, characters, and the number of windows of its document."""
    rows = windows.groupBy("document_id", "window_no").agg(F.count(F.lit(1)).alias("size"), F.sum("n_chars").alias("chars"), F.min("reading_order").alias("first"))
    return rows.withColumn("windows", F.count(F.lit(1)).over(Window.partitionBy("document_id")))


def split_overflow(windows: DataFrame, fails, size: int = SIZE) -> DataFrame:
    """part of each chunk ('' for a window that was not cut, else a string of 0s and 1s, in processing order) and whether its part still fails.

    fails(parts) says, from a part's chars and size, whether its output overflowed. Failed parts of more than one chunk are cut in
    halves (the first at least one chunk), again and again until none is left; parts of one chunk keep their error. Halving
    a window of `size` chunks ends after log2(size) rounds. A window is one row of at most `size` chunks meanwhile, so nothing is sorted between rounds.
    """
    item = F.struct(*windows.columns)
    listed = windows.groupBy("document_id", "window_no").agg(F.array_sort(F.collect_list(F.struct("reading_order", item.alias("row")))).alias("items"))
    overflows = lambda items: F.coalesce(fails(F.aggregate(items, F.lit(0).cast("bigint"), lambda n, c: n + c["row"]["n_chars"]), F.size(items)), F.lit(False))

    def halves(p: Column) -> Column:
        half = F.greatest(F.lit(1), F.floor(F.size(p["items"]) / 2).cast("int"))
        cut = lambda end, begin, length: F.struct(F.concat(p["part"], F.lit(end)).alias("part"), F.slice(p["items"], begin, length).alias("items"))
        return F.when((F.size(p["items"]) > 1) & overflows(p["items"]), F.array(cut("0", F.lit(1), half), cut("1", half + 1, F.size(p["items"])))).otherwise(F.array(p))

    parts = F.array(F.struct(F.lit("").alias("part"), F.col("items").alias("items")))
    for _ in range(math.ceil(math.log2(max(size, 2)))):
        parts = F.flatten(F.transform(parts, halves))
    cut = listed.select(F.explode(parts).alias("p")).select("p.part", overflows(F.col("p.items")).alias("failed"), F.explode("p.items").alias("i"))
    return cut.select("i.row.*", "part", "failed")


def artefacts(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """What each part of a window was given and gave: document_id, artefact_no (in processing order), window_no, part, chunk_ids, chars, failed."""
    joined = parts.join(chunks.select("document_id", "reading_order", "chunk_id").hint("merge"), ["document_id", "reading_order"])
    rows = joined.groupBy("document_id", "window_no", "part").agg(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id"))).alias("s"), F.sum("n_chars").alias("chars"), F.bool_or("failed").alias("failed"))
    order = Window.partitionBy("document_id").orderBy("window_no", "part")
    return rows.select("document_id", F.row_number().over(order).alias("artefact_no"), "window_no", "part", F.transform("s", lambda x: x["chunk_id"]).alias("chunk_ids"), "chars", "failed")


def fill_paths(groups: DataFrame, order_col: str) -> DataFrame:
    """An empty path takes the last non-empty one of its document."""
    order = Window.partitionBy("document_id").orderBy(order_col)
    return groups.withColumn("path", F.last(F.nullif("path", F.lit("")), ignorenulls=True).over(order))


def merge_continuations(groups: DataFrame, order_col: str) -> DataFrame:
    """merged_no of each group: neighbours of one path and role are merged while the sentence goes on (groups are disjoint)."""
    order = Window.partitionBy("document_id").orderBy(order_col)
    same = F.lag("path").over(order).eqNullSafe(F.col("path")) & F.lag("role").over(order).eqNullSafe(F.col("role")) & tx.continues(F.lag("text").over(order), F.col("text"))
    first = F.row_number().over(order) == 1
    opened = groups.withColumn("opens", F.when(~first & same, 0).otherwise(1))
    return opened.withColumn("merged_no", F.sum("opens").over(order).cast("int")).drop("opens")
