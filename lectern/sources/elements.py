"""Nested element trees (JSON) to rows, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import materialize

# Where children stand, in the order they are read, and the types that carry text.
CHILDREN = ("$.kids", "$['list items']", "$.cells", "$.rows")
TYPES = ("heading", "paragraph", "caption", "list item")


def _children(kind: int, at: str) -> Column:
    """Children of one kind as structs of kind, position and node."""
    found = F.coalesce(F.try_variant_get("node", at, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(found, lambda v, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), v.alias("v")))


def walk(trees: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Elements with text in pre-order: id, unit_no, type, content. Goes level by level until a level is empty, however deep.

    Hidden elements and those of other types are not emitted, but what is below them is visited. Each level is a table in the shared
    folder, so nothing stays cached.
    """
    level = trees.select(F.col(id_col), F.try_parse_json(json_col).alias("node"), F.array().cast("array<int>").alias("path"))
    levels = []
    while True:
        levels.append(level)
        below = [_children(k, at) for k, at in enumerate(CHILDREN)]
        level = level.select(id_col, "path", F.explode(F.concat(*below)).alias("c")).select(id_col, F.col("c.v").alias("node"), F.concat("path", F.array("c.k", "c.i")).alias("path"))
        level = materialize(level, "level")
        if level.isEmpty():
            break
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    kind, content = F.try_variant_get("node", "$.type", "string"), F.try_variant_get("node", "$.content", "string")
    hidden = F.coalesce(F.try_variant_get("node", "$['hidden text']", "boolean"), F.lit(False))
    shown = nodes.select(id_col, "path", kind.alias("type"), F.trim(content).alias("content"), hidden.alias("hidden")).where(F.col("type").isin(*TYPES) & (F.col("content") != "") & ~F.col("hidden"))
    return shown.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("path")).alias("unit_no"), "type", "content")


def answer_rows(private: DataFrame, exams: DataFrame, wanted: DataFrame) -> DataFrame:
    """question_set_id, question_id, answer_index, and error: the private key of each wanted set, else the first exam's (by file) that
    has the set, with ids `<set>-q<n>` where it names none, else one row that says so.

    private: question_set_id, pos, question_id, answer_index; exams: file, question_set_id, questions (array of id, answer_index).
    """
    own = private.select("question_set_id", F.lit(0).alias("__source"), F.lit("").alias("__file"), "pos", "question_id", "answer_index")
    listed = exams.select("question_set_id", F.lit(1).alias("__source"), F.col("file").alias("__file"), F.posexplode("questions").alias("pos", "q"))
    named = F.coalesce(F.nullif("q.id", F.lit("")), F.concat("question_set_id", F.lit("-q"), (F.col("pos") + 1).cast("string")))
    listed = listed.select("question_set_id", "__source", "__file", "pos", named.alias("question_id"), F.coalesce("q.answer_index", F.lit(0)).alias("answer_index"))
    every = own.unionByName(listed)
    best = Window.partitionBy("question_set_id").orderBy("__source", "__file")
    chosen = every.withColumn("__rank", F.dense_rank().over(best)).where("__rank = 1").select("question_set_id", "pos", "question_id", "answer_index")
    joined = wanted.select("question_set_id").distinct().join(chosen.hint("merge"), "question_set_id", "left")
    return joined.withColumn("error", F.when(F.col("question_id").isNull(), "Answer key not found."))


#: Documents are dealt to so many folders of a table.
FOLDERS = 16


def _folder(document: Column) -> Column:
    return F.pmod(F.xxhash64(document.cast("string")), F.lit(FOLDERS)).cast("int")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each grain, dealt by document_id."""
    for name, frame in tables.items():
        _dealt(frame).write.mode("overwrite").partitionBy("__folder").parquet(f"{folder}/{name}")


def write_documents(tables: dict[str, DataFrame], folder: str) -> None:
    """Rows of documents take the place of those they had; only the folders that these documents are dealt to are written again."""
    for name, frame in tables.items():
        spark = frame.sparkSession
        new = materialize(_dealt(frame), "saved")
        old = spark.read.parquet(f"{folder}/{name}").join(F.broadcast(new.select("__folder").distinct()), "__folder", "left_semi")  # FOLDERS rows at most
        kept = old.join(new.select("document_id").distinct().hint("merge"), "document_id", "left_anti")
        merged = materialize(kept.select(*new.columns).unionByName(new), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__folder").parquet(f"{folder}/{name}")


def _dealt(frame: DataFrame) -> DataFrame:
    return frame.withColumn("__folder", _folder(F.col("document_id"))).repartition("__folder")


def read_table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").drop("__folder")
