"""JSON files of studies: exams and representations, read from folders with what their paths say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.study import normalise_exams

CORRUPT = "_corrupt"
EXAM = (
    "id string, document_id string, title string, question_set_id string, enabled boolean, timing_mode string, time_limit_seconds string,"
    " representation_condition struct<id:string,visible_representations:array<string>>, questions array<struct<text:string,choices:array<string>,answer_index:int>>"
)
REPRESENTATION = "block_id string, representation struct<kind:string,label:string,value:string,text:string,items:array<string>,background_color:string,background_opacity:double>"


def _file() -> Column:
    """The decoded path of the file that a row is from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object (or a list of them) over several lines: the schema's columns, `file` (the decoded path), and _corrupt, the whole text of a file that
    is no JSON. The path may have wildcards."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path).withColumn("file", _file())


def packed_json(packed: DataFrame, schema: str) -> DataFrame:
    """As json_files, of files that are packed as rows of a table (file, text): hundreds of thousands of small files are neither listed nor opened one by one."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    names = StructType.fromDDL(schema).names
    one = F.from_json("text", f"{schema}, {CORRUPT} string", options)
    many = F.from_json(F.concat(F.lit('{"all":'), "text", F.lit("}")), f"all array<struct<{schema}>>, {CORRUPT} string", options)
    broken = F.struct(*(F.lit(None).alias(c) for c in names), F.col("text").alias(CORRUPT))
    entries = F.transform(F.array_compact(many["all"]), lambda e: F.struct(*(e[c].alias(c) for c in names), F.lit(None).alias(CORRUPT)))
    listed = F.when(many[CORRUPT].isNotNull(), F.array(broken)).otherwise(entries)
    rows = F.when(F.startswith(F.ltrim("text"), F.lit("[")), listed).otherwise(F.array_compact(F.array(one)))
    return packed.select("file", F.explode(rows).alias("r")).select("r.*", "file")


def _readable(schema: str) -> Column:
    """Whether a file is JSON. Spark refuses plans that need the corrupt text of files and nothing else of them, so a field is looked at as well."""
    field = F.col(schema.split()[0])
    return F.col(CORRUPT).isNull() & (F.length(F.coalesce(field, F.lit(""))) >= 0)


def stem(file: Column) -> Column:
    """A file's name without folders and its ending."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def folder(file: Column) -> Column:
    """The name of the folder that a file is in; of folders that Spark has partitioned by a column (`column=name`) the name."""
    return F.regexp_replace(F.regexp_extract(file, "([^/]+)/[^/]*$", 1), "^[^=]*=", "")


def exams(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Exams of a folder, normalised, with their file; files that are no JSON objects are passed over. An exam without an id is called as its file,
    or as `name` says (a column over file). In order of `file` where that matters."""
    return exam_rows(json_files(spark, path, EXAM), name)


def exam_rows(read: DataFrame, name: Column | None = None) -> DataFrame:
    """The exams of what json_files or packed_json has read; see exams."""
    rows = read.where(_readable(EXAM)).drop(CORRUPT)
    rows = rows.withColumn("fallback_id", stem(F.col("file")) if name is None else name)
    rows = rows.withColumn("condition_id", F.col("representation_condition.id")).withColumn("visible", F.col("representation_condition.visible_representations"))
    return normalise_exams(rows, ("file",))


def unreadable(spark: SparkSession, path: str, schema: str = EXAM) -> DataFrame:
    """file and text of the files that are no JSON."""
    return json_files(spark, path, schema).where(~_readable(schema)).select("file", F.col(CORRUPT).alias("text"))


def representations(spark: SparkSession, path: str) -> DataFrame:
    """block_id and its representations, in order of their files: the id from the file, else from the folder's name. Files without a representation, or that are no
    JSON, are passed over; whether a job has ended is not asked."""
    return representation_rows(json_files(spark, path, REPRESENTATION))


def representation_rows(read: DataFrame) -> DataFrame:
    """The representations of what json_files or packed_json has read; see representations."""
    rows = read.where(_readable(REPRESENTATION) & F.col("representation").isNotNull())
    block = F.coalesce(F.nullif(F.col("block_id"), F.lit("")), folder(F.col("file")))
    listed = rows.groupBy(block.alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("file", F.col("representation.kind").alias("kind"), "representation"))).alias("s"))
    return listed.select("block_id", F.transform("s", lambda x: x["representation"]).alias("representations"))
