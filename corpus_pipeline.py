"""The corpus pipeline over documents: five stages, each one operator of lectern.llm on all that its predecessor kept.

Documents that the toxicity classifier rejects go; repeated passages are cut out of the texts that stay; one document of
each near-duplicate group stays; documents that contain a benchmark item go; what is left is packed into sequences. Each stage's
result is written as Parquet and read again as the next one's documents. Each function takes (spark, docs, sf_dir).

Defined cases of every stage: null and empty texts are kept (texts of no words are no near duplicates but of equal texts), a null id is
an id like any other, repeated rows are treated alike, texts are read whole however long they are, other columns come through
whatever their names, an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, linededup, packing, toxicity
from lectern.llm.queries import tokenizer, training_labels
from lectern.session import materialize, prepare, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay; labels that may be learned from come from the labels table."""
    return toxicity.keep_clean(docs, training_labels(table(prepare(spark), sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave all but their first place; n_chars follows the text. A document may become empty, but stays."""
    prepare(spark)
    found = linededup.remove_repeats(docs).drop("__removed")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; of equal rows one."""
    prepare(spark)
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark table go."""
    return decontaminate.clean(docs, table(prepare(spark), sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces in sequences; a null text is the end id alone."""
    prepare(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
