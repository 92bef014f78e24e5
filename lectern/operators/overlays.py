"""Placement of blocks' features on page regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import once

# Width of a page in the reader, its height, and the sizes of chips and lines.
PAGE_WIDTH, PAGE_HEIGHT = 760.0, 980.0
#: More than rounding can change of a score.
NEAR = 1e-5


def overlay_rows(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each chunk of a block, in the block's order; unknown ids are dropped, the first known chunk carries the label."""
    named = blocks.select("document_id", "block_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    joined = named.join(chunks.select("document_id", "chunk_id", "page_number", "x", "y", "width", "height", "reading_order").hint("merge"), ["document_id", "chunk_id"])
    first = F.row_number().over(Window.partitionBy("document_id", "block_id").orderBy("pos")) == 1
    return joined.withColumn("overlay_id", F.concat_ws(":", "block_id", "chunk_id")).withColumn("has_label", first)


def unmapped(chunks: DataFrame, overlays: DataFrame) -> DataFrame:
    return chunks.join(overlays.select("document_id", "chunk_id").hint("merge"), ["document_id", "chunk_id"], "left_anti").withColumn("overlay_id", F.concat(F.lit("unmapped:"), "chunk_id"))


def page_order(overlays: DataFrame) -> DataFrame:
    """place of each overlay on its page by (y, x), and the number of blocks of the page."""
    page = Window.partitionBy("document_id", "page_number")
    ordered = overlays.withColumn("place", F.row_number().over(page.orderBy("y", "x", "overlay_id")))
    return ordered.withColumn("blocks", F.size(F.collect_set("block_id").over(page)).cast("long"))


def region(width: Column, height: Column, page: Column, x: Column, y: Column, index: Column) -> Column:
    """Inner size of a region and its place in page order."""
    w, h = F.greatest(width * PAGE_WIDTH - 4, F.lit(1.0)), F.greatest(height * PAGE_HEIGHT - 4, F.lit(1.0))
    return F.struct(w.alias("w"), h.alias("h"), (page * 100000.0 + y * 1000.0 + x + index * 0.0001).alias("ord"))


def summary_height(text: Column, width: Column) -> Column:
    lines = F.least(F.greatest(F.ceil(F.length(text) * 7.0 / F.greatest(width - 16, F.lit(24.0))), F.lit(1)), F.lit(3))
    return (lines * 18 + 10).cast("double")


def chips_height(items: Column, width: Column) -> Column:
    """Height of chips packed in rows: a chip that does not fit opens a row (a fold over the items); empty items have no chip."""
    wide = F.greatest(width, F.lit(24.0))

    def step(s: Column, item: Column) -> Column:
        chip = F.least(F.length(item) * 7.2 + 14, wide)
        opens = (s["used"] > 0) & (s["used"] + 4.0 + chip > wide)
        used = F.when(opens | (s["used"] == 0), chip).otherwise(s["used"] + 4.0 + chip)
        return F.struct(F.when(opens, s["rows"] + 1).otherwise(s["rows"]).alias("rows"), used.alias("used"))

    start = F.struct(F.lit(1).alias("rows"), F.lit(0.0).alias("used"))
    rows = F.aggregate(F.filter(items, lambda item: item != ""), start, step)["rows"]
    return (rows * 23 + (rows - 1) * 4).cast("double")


def best_layout(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The best pair of a summary region and a keyword region of each block.

    regions: keys, idx, page_number, y, w, h, ord, need_s, need_k (heights that the summary and the keywords need there). A
    keyword region may not lie before the summary's. The first maximum wins (summary region outer, keyword region inner). What a region is worth
    by itself is worked out once. The pairs of a block's regions are then compared in its row, those of summary regions only that could reach the best score of one
    region for both: with the best keywords at no distance at least as much.
    """

    def fit(need: Column) -> Column:
        height = F.col("h")
        fits = F.when(need <= height, 10000.0).otherwise(0.0)
        return fits + 100 * F.least(height / F.greatest(need, F.lit(1.0)), F.lit(4.0)) + F.col("w") * height / 1000 - 40 * F.greatest(need - height, F.lit(0.0)) - F.col("ord") / 100

    worth = F.struct("idx", "page_number", "y", "ord", fit(F.col("need_s")).alias("s"), fit(F.col("need_k")).alias("k"), (fit(F.col("need_s") + 4 + F.col("need_k")) + 20).alias("both"))
    listed = regions.groupBy(*keys).agg(F.collect_list(worth).alias("__r"))

    def pair(s: Column, k: Column) -> Column:
        score = F.when(s["idx"] == k["idx"], s["both"]).otherwise(s["s"] + k["k"] - 0.02 * F.abs(k["ord"] - s["ord"]))
        return F.struct(score.alias("score"), k["idx"].alias("k"))

    def best_of(s: Column) -> Column:
        allowed = F.filter("__r", lambda k: (k["page_number"] > s["page_number"]) | ((k["page_number"] == s["page_number"]) & (k["y"] >= s["y"] - 0.001)))
        ranked = F.transform(F.transform(allowed, lambda k: pair(s, k)), lambda p: F.struct((-F.round(p["score"], 6)).alias("rank"), s["idx"].alias("summary_at"), p["k"].alias("keywords_at"), p["score"].alias("score")))
        return F.array_min(ranked)

    def could_win(bar: Column) -> Column:
        # a region without a place is not allowed with itself, and no score is told from one that is null
        reaches = lambda s: F.greatest(s["s"] + bar["k"], s["both"]) >= bar["least"] - NEAR
        return F.filter("__r", lambda s: bar["unknown"] | F.coalesce(reaches(s), F.lit(True)))

    alone = F.transform("__r", lambda r: F.when(r["y"].isNotNull() & r["page_number"].isNotNull() & ~F.isnan(r["both"]), r["both"]))
    unknown = F.exists("__r", lambda r: (r["s"] + r["k"] + r["both"]).isNull())
    bar = F.struct(F.array_max(F.transform("__r", lambda r: r["k"])).alias("k"), F.array_max(alone).alias("least"), unknown.alias("unknown"))
    # exploded, not filtered: a filter on the best would be worked out on its own
    best = listed.select(*keys, F.explode(F.array_compact(F.array(F.array_min(F.transform(once(bar, could_win), best_of))))).alias("__best"))
    return best.select(*keys, "__best.summary_at", "__best.keywords_at", "__best.score")


def keyword_fallback(blocks: DataFrame, chunks: DataFrame, enabled: Column) -> DataFrame:
    """keywords of blocks without any representation: those of the block's first chunk that has some; null where models are on or
    none has. blocks: document_id, block_id (once in a document), chunk_ids, has_representations; chunks: document_id, chunk_id, keywords.
    """
    wanted = blocks.withColumn("__open", F.coalesce(~enabled & ~F.col("has_representations"), F.lit(False)))
    # the keywords are looked at once the join is done: a filter on them below it would work them out twice
    named = wanted.select("document_id", "block_id", F.posexplode_outer(F.when(F.col("__open"), F.col("chunk_ids"))).alias("pos", "chunk_id"))
    joined = named.join(chunks.select("document_id", "chunk_id", F.col("keywords").alias("__k")).hint("merge"), ["document_id", "chunk_id"], "left")
    return joined.groupBy("document_id", "block_id").agg(F.min_by("__k", F.when(F.size("__k") > 0, F.col("pos"))).alias("keywords"))


def place_others(representations: Column, summary_at: Column, keywords_at: Column, regions: Column) -> Column:
    """Array of (kind, region) of kinds other than keywords and summary: the first of each kind only, in the summary's region, else the
    keywords', else in turn over the regions. representations: array of structs with a kind, in order."""
    blank = F.filter(representations, lambda r: (r["kind"] != "") & ~r["kind"].isin("keywords", "summary"))
    kinds = F.array_distinct(F.transform(blank, lambda r: r["kind"]))
    return F.when(regions > 0, F.transform(kinds, lambda k, i: F.struct(k.alias("kind"), F.coalesce(summary_at, keywords_at, i % regions).cast("int").alias("region")))).otherwise(F.array().cast("array<struct<kind:string,region:int>>"))
