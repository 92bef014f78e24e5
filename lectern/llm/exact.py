"""Exact duplicates by sorting the texts themselves, with DataFrame functions only.

Texts are dealt out by ranges whose ends Spark's range partitioner samples, then sorted in their partition (the sort spills), so that equal
texts are neighbours; a text that differs from its neighbour, compared as a whole, begins a new group. A row is placed by its
text's first characters and, among texts that begin alike, by a 64-bit digest, so that a range's end is of bounded size; rows of
one place are sorted and compared by the whole text, so the digest decides nothing.

A text with many copies would fill one task. The bytes of each digest are summed first (a narrow shuffle of pre-aggregated rows); those with more than
1 / `HEAVY` of all bytes, and `CELL_BYTES` at least, are dealt by id to cells of about that size. There are at most `HEAVY` such digests
however large the table is, so they are broadcast. Each of their cells gives one representative; representatives are grouped by their whole
texts and the totals (one row for each heavy text) are looked up by the rows of the cells.

Defined cases: a null text counts as empty; a null id is smaller than any other when the largest stays, and larger when the smallest
stays; of rows equal in id and text one is kept, and each counts; ids may have any type that can be ordered; a text is read whole
however long it is; other columns are ignored or carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import materialize

#: At most so many digests are dealt to cells.
HEAVY = 100_000
CELL_BYTES = 1 << 18
#: Characters of a text that its place is told by.
PREFIX = 32


def _cells(rows: DataFrame, heavy_share: int, cell_bytes: int) -> DataFrame:
    """Adds __cell: the number of a heavy text's cell, drawn from the row's id; null for the other texts."""
    weights = materialize(rows.groupBy("__hash").agg(F.sum(F.octet_length("__text").cast("bigint") + 16).alias("bytes"), F.count(F.lit(1)).alias("n")), "weights")
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    limit = max(cell_bytes, total // heavy_share + 1)
    heavy = weights.where((F.col("n") > 1) & (F.col("bytes") > limit)).select(F.col("__hash").alias("__heavy"), F.ceil(F.col("bytes") / limit).alias("__cells"))
    joined = rows.join(F.broadcast(heavy), F.col("__hash") == F.col("__heavy"), "left")
    return joined.withColumn("__cell", F.pmod(F.xxhash64("__id"), F.col("__cells"))).drop("__heavy", "__cells")


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    rows: bool = False,
    heavy_share: int = HEAVY,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256 (of the normalised text); with `rows` also __row, the whole
    row. `normalise` says which texts are equal (as they are, if left out); `keep` is smallest or largest. Defined cases: see the module's text."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if rows else []
    keyed = docs.select(F.col(id_col).alias("__id"), (normalise(text) if normalise else text).alias("__text"), *carried).withColumn("__hash", F.xxhash64("__text"))
    keyed = _cells(keyed, heavy_share, cell_bytes).withColumn("__prefix", F.left("__text", F.lit(PREFIX)))
    place = ["__prefix", "__hash", "__cell"]
    # the windows are dealt by the ranges' own columns: the sampled ranges are their only shuffle of texts
    window = Window.partitionBy(*place).orderBy("__text", "__id")
    sorted_ = keyed.repartitionByRange(*place)
    same_text = F.lag("__text").over(window).eqNullSafe(F.col("__text"))  # texts are never null, so a first row differs
    sorted_ = sorted_.withColumn("__new", ~same_text).withColumn("__first", F.col("__new") | ~F.lag("__id").over(window).eqNullSafe(F.col("__id")))
    sorted_ = sorted_.withColumn("__run", F.sum(F.col("__new").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    narrow = sorted_.withColumn("__text_sha", F.sha2("__text", 256)).withColumn("__text", F.when(F.col("__new") & F.col("__cell").isNotNull(), F.col("__text")))
    run = Window.partitionBy(*place, "__run")
    counted = narrow.withColumn("__n", F.count(F.lit(1)).over(run)).withColumn("__best", best("__id").over(run))
    cells = materialize(counted.select("__id", "__cell", "__text", "__text_sha", "__first", "__n", "__best", *(["__row"] if rows else [])), "cells")
    totals = cells.where(F.col("__text").isNotNull()).groupBy("__text").agg(F.sum("__n").alias("__all_n"), best("__best").alias("__all_best"))
    totals = totals.select(F.sha2("__text", 256).alias("__total_of"), "__all_n", "__all_best")
    found = cells.join(F.broadcast(totals), F.col("__cell").isNotNull() & (F.col("__text_sha") == F.col("__total_of")), "left")
    in_cell = F.col("__total_of").isNotNull()
    found = found.withColumn("__n", F.when(in_cell, F.col("__all_n")).otherwise(F.col("__n"))).withColumn("__best", F.when(in_cell, F.col("__all_best")).otherwise(F.col("__best")))
    return found.select(
        F.col("__id").alias(id_col),
        F.col("__best").alias("keep_id"),
        F.col("__n").cast("bigint").alias("group_size"),
        (F.col("__first") & F.col("__id").eqNullSafe(F.col("__best"))).alias("kept"),
        F.col("__text_sha").alias("text_sha256"),
        *(["__row"] if rows else []),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "smallest") -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns."""
    return find(docs, id_col, text_col, normalise, keep, rows=True).where("kept").select("__row.*")
