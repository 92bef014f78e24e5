"""Document fingerprints by I-Match with randomised lexicon subsets, with DataFrame functions only.

A term is a lower-cased run of letters and digits. The lexicon has the terms whose document frequency, counted over all documents,
lies in a band: at least `rare` and at most `common` of the documents. It has at most (mean number of distinct terms of a
document) / `rare` terms however many documents there are, so it is sent along with the plan; it is looked up by hash slot. Its size
is checked: above `MOST_TERMS` it is an error that asks for a larger `rare`.

Beside the whole lexicon there are `families` * `depth` random subsets of it, which leave out more and more: subset l of a family has
a term with probability 2**-l, drawn from the term's digest, and each is part of the one before. A text's distinct terms in a
subset are sorted and hashed; the fingerprint is all these hashes, the whole lexicon's first. Every in-band term of every text is in
the whole lexicon's hash and in half of the families' first ones, so a changed term changes the fingerprint, whereas hashes of the
sparser subsets outlive larger changes. The likeness of two fingerprints is the share of equal hashes among the subsets that either
text has terms in.

Defined cases: a null text is an empty one; a text with no term in the band has nothing to be told by and keeps all its terms; texts
without any term share one fingerprint (likeness 1 to each other, 0 to others); equal texts have equal fingerprints; a text is read
whole however long it is; repeated rows are fingerprinted each; a null id comes last in the order of documents, equal ids stand in the
order of their texts' hashes; ids may have any type that can be ordered; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import materialize

RARE, COMMON = 0.0005, 0.2
FAMILIES, DEPTH = 6, 12
SLOTS = 1 << 16
EMPTY = "." * 8
#: Terms that a lexicon may have; documents of 1,000 distinct terms on average have half as many at most.
MOST_TERMS = 4_000_000
#: Rows of a range of ids in which documents find their successors, and how many ranges there may be; ranges of more rows are sorted with spilling.
RANGE_ROWS, MOST_RANGES = 2000, 4096
_EDGE, _SEP = "\u0002", "\u0001"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text_col: str, rare: float = RARE, common: float = COMMON) -> Column:
    """The lexicon as a constant array of SLOTS strings, each the slot's terms between marks."""
    counts = materialize(docs.select(F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "terms")
    total = docs.count()
    inside = counts.where((F.col("n") >= max(2.0, rare * total)) & (F.col("n") <= max(2.0, common * total)))
    if inside.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"the lexicon has more than {MOST_TERMS} terms; choose a larger share for rare")
    marked = F.concat(F.lit(_EDGE), "term", F.lit(_EDGE))
    slots = inside.groupBy(F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("id")).agg(F.array_join(F.array_sort(F.collect_list(marked)), "").alias("terms"))
    # one row of SLOTS short strings; bounded: see the module's text
    every = docs.sparkSession.range(SLOTS).join(slots.hint("merge"), "id", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("terms", F.lit("")).alias("terms")))).alias("all"))
    return F.split(F.lit(every.select(F.array_join(F.col("all.terms"), _SEP)).first()[0]), _SEP)


def _known(slots: Column, term: Column) -> Column:
    slot = F.element_at(slots, F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int") + 1)
    return F.contains(slot, F.concat(F.lit(_EDGE), term, F.lit(_EDGE)))


def _hash(kept: Column) -> Column:
    """Hash of sorted terms."""
    return F.when(F.size(kept) == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(F.transform(kept, lambda t: t["t"]), " ")), 1, 8))


def fingerprint(rows: DataFrame, text_col: str, out: str, slots: Column, families: int = FAMILIES, depth: int = DEPTH) -> DataFrame:
    """Adds the fingerprint of a text column: the hashes of the whole lexicon and of every subset, an array."""
    rows = rows.withColumn("__all", terms(F.col(text_col))).withColumn("__in", F.filter("__all", lambda t: _known(slots, t)))
    rows = rows.withColumn("__in", F.when(F.size("__in") == 0, F.col("__all")).otherwise(F.col("__in"))).drop("__all")
    rows = rows.withColumn("__kept", F.transform(F.array_sort("__in"), lambda t: F.struct(t.alias("t"), F.md5(t).alias("m")))).drop("__in")
    limits = F.array(*[F.lit(f"{4096 >> level:03x}") for level in range(1, depth + 1)])

    def family(j: int) -> Column:
        """Hashes of the family's subsets: a term's draw are three digits of its digest, a subset has the draws below its limit."""
        step = lambda limit: lambda kept: F.filter(kept, lambda t: F.substring(t["m"], 3 * j + 1, 3) < limit)
        start = F.struct(F.col("__kept").alias("kept"), F.array().cast("array<string>").alias("out"))
        halved = lambda acc, limit: F.struct(step(limit)(acc["kept"]).alias("kept"), acc["out"].alias("out"))
        add = lambda acc: F.struct(acc["kept"].alias("kept"), F.concat(acc["out"], F.array(_hash(acc["kept"]))).alias("out"))
        return F.aggregate(limits, start, lambda acc, limit: F.element_at(F.transform(F.array(halved(acc, limit)), add), 1), lambda acc: acc["out"])

    return rows.withColumn(out, F.concat(F.array(_hash(F.col("__kept"))), *[family(j) for j in range(families)])).drop("__kept")


def as_text(print_: Column) -> Column:
    return F.array_join(print_, "")


def likeness(x: Column, y: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms in."""
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    active = F.size(F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    equal = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != EMPTY)))
    return F.when(active == 0, F.lit(1.0)).otherwise(equal / active)


def with_next(rows: DataFrame, id_col: str, carried: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds a struct of the carried columns of the next row by descending id (ties: by __th); the last row's next is the first.

    Rows are dealt out by ranges of ids with about as many rows each (Spark's range partitioner samples their ends); the last row
    of each range in ascending order is also given to the range after it, whose first row it follows. The ends are part of the plan; there are at
    most MOST_RANGES of them however many rows there are.
    """
    place = F.struct(F.col(id_col).alias("id"), F.col("__th").alias("th"))
    count = max(1, min(MOST_RANGES, rows.count() // range_rows))
    ranged = rows.select(place.alias("p")).repartitionByRange(count, "p")
    # one row for each range, MOST_RANGES at most
    ends = sorted(((r["k"], r["end"]) for r in ranged.groupBy(F.spark_partition_id().alias("k")).agg(F.max("p").alias("end")).collect()), key=lambda r: r[0])
    if not ends:
        return rows.withColumn(out, F.struct(*carried))
    kind = ranged.schema["p"].dataType
    stride = math.isqrt(len(ends)) + 1
    groups = [[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(end, kind)]) for _, end in ends[k : k + stride]] for k in range(0, len(ends), stride)]
    below = lambda found: F.size(F.filter(found, lambda end: end < F.col("__place")))
    # the range's number: how many ends lie below, in two steps
    tops, table = F.array(*[g[-1] for g in groups]), F.array(*[F.array(*g) for g in groups])
    rows = rows.withColumn("__place", place).withColumn("__group", F.least(below(tops), F.lit(len(groups) - 1)))
    rows = rows.withColumn("__inner", F.element_at(table, F.col("__group") + 1)).withColumn("__within", below(F.col("__inner")))
    last = F.col("__place").eqNullSafe(F.get("__inner", "__within"))
    number = F.col("__group") * stride + F.col("__within")
    own = F.struct(number.alias("range"), F.lit(False).alias("extra"))
    places = F.when(last, F.array(own, F.struct(((number + 1) % len(ends)).alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    rows = rows.withColumn("__to", F.explode(places)).drop("__group", "__inner", "__within")
    window = Window.partitionBy("__to.range").orderBy("__to.extra", F.col("__place").desc())
    return rows.withColumn(out, F.lead(F.struct(*carried)).over(window)).where("NOT __to.extra").drop("__to", "__place")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, common: float = COMMON, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, n_chars, edited_sha256, both fingerprints and likenesses for every text and its edited text (its last third replaced by the
    beginning of the next document, by descending id). Defined cases: see the module's text."""
    slots = lexicon(docs, text_col, rare, common)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__th", F.xxhash64("__text"))
    rows = with_next(fingerprint(rows, "__text", "__print", slots), "__id", ["__text", "__print"], "__next", range_rows)
    length = F.length("__text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.left(F.col("__text"), length - third), F.left(F.col("__next.__text"), third))
    rows = rows.withColumn("__edited", edited).withColumn("__next", F.col("__next.__print"))
    rows = fingerprint(rows, "__edited", "__eprint", slots)
    return rows.select(
        F.col("__id").alias(id_col),
        length.cast("bigint").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__print")).alias("fingerprint"),
        as_text(F.col("__eprint")).alias("edited_fingerprint"),
        likeness(F.col("__print"), F.col("__eprint")).alias("near_edited"),
        likeness(F.col("__print"), F.col("__next")).alias("near_next"),
    )
