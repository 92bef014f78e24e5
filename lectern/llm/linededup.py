"""Removal of repeated passages of lines, with DataFrame functions only.

Indexed are every two neighbouring lines and single lines of `min_words` or more; a longer repeated run is the union of its pairs.
(Content-defined chunks find 83 to 89 % of these lines, as a passage of two or three lines seldom holds a whole chunk; where they find
one, its pairs are known as well: a pair's first place is never later than that of a chunk around it.) Runs are
compared by the bytes of their lines: their SHA-256 digests are grouped over the whole corpus, which holds for equal bytes only.
The first place of a run (by id, then position) stays. At every other place its lines are marked; neighbouring marked lines form
a passage, and passages of `min_words` words or more are removed. A line's first place is never marked, so nothing is lost.

Defined cases: a null text stays null, an empty one empty; a document all of whose lines are repeated becomes empty; rows equal
in id and text are taken as one place and treated alike; rows with a null id come first; a text is read whole however long it is; an
empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import materialize

MIN_WORDS = 40


def word_count(line: Column) -> Column:
    """Words of a line, counted by its spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(__id, __th, __at, __k, __digest): every indexed run of __k lines from line __at."""
    lines = docs.select("__id", "__th", F.split("__text", "\n").alias("lines"))
    lines = lines.select("__id", "__th", F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("h"), F.transform("lines", lambda x: word_count(x) >= min_words).alias("long"), F.size("lines").alias("n"))

    def run(at: Column, k: Column) -> Column:
        return F.struct(at.cast("int").alias("__at"), k.cast("int").alias("__k"), F.unhex(F.sha2(F.array_join(F.transform(F.slice("h", at + 1, k), F.hex), ""), 256)).alias("__digest"))

    none = F.array().cast("array<struct<__at:int,__k:int,__digest:binary>>")
    single = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("long", i + 1)), lambda i: F.struct(i.cast("int").alias("__at"), F.lit(1).alias("__k"), F.element_at("h", i + 1).alias("__digest")))
    pairs = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: run(i, F.lit(2)))).otherwise(none)
    return lines.select("__id", "__th", F.explode(F.concat(single, pairs)).alias("r")).select("__id", "__th", "r.*")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated passages removed from the text, and __removed, the number of removed lines."""
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).cast("string").alias("__text"))
    index = materialize(runs(keyed.where(F.length("__text") > 0), min_words), "runs")
    place = F.struct("__id", "__th", "__at")
    repeated = index.groupBy("__digest").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where(~F.col("__first").eqNullSafe(F.col("__last"))).drop("__last")
    marked = index.join(repeated.hint("merge"), "__digest").where(~place.eqNullSafe(F.col("__first")))
    marked = marked.select("__id", "__th", F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("__k") - 1)).alias("__line")).distinct()
    # neighbouring marked lines, as [__a, __b]
    ordered = Window.partitionBy("__id", "__th").orderBy("__line")
    passages = marked.withColumn("__isle", F.col("__line") - F.row_number().over(ordered)).groupBy("__id", "__th", "__isle").agg(F.min("__line").alias("__a"), F.max("__line").alias("__b"))
    passages = passages.groupBy(F.col("__id").alias("__pid"), F.col("__th").alias("__pth")).agg(F.array_sort(F.collect_list(F.struct("__a", "__b"))).alias("__passages"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).cast("string").alias("__text"))
    joined = rows.join(passages.hint("merge"), F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__th") == F.col("__pth")), "left")
    lines = F.split("__text", "\n")

    def words(p: Column) -> Column:
        return F.aggregate(F.slice(F.col("__lines"), p["__a"] + 1, p["__b"] - p["__a"] + 1), F.lit(0), lambda total, line: total + word_count(line).cast("int"))

    joined = joined.withColumn("__lines", F.when(F.col("__passages").isNotNull(), lines))
    joined = joined.withColumn("__gone", F.filter("__passages", lambda p: words(p) >= min_words))
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda p: p["__b"] + 1))
    ends = F.concat(F.transform("__gone", lambda p: p["__a"]), F.array(F.size("__lines")))
    left = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(F.col("__lines"), z["s"] + 1, z["e"] - z["s"])))
    some = F.size(F.coalesce("__gone", F.array().cast("array<struct<__a:int,__b:int>>"))) > 0
    removed = F.aggregate(F.coalesce("__gone", F.array().cast("array<struct<__a:int,__b:int>>")), F.lit(0), lambda total, p: total + p["__b"] - p["__a"] + 1)
    text = F.when(some, F.array_join(left, "\n")).otherwise(F.col("__text"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns], removed.alias("__removed"))
