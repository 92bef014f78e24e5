"""Queries of requests to a model service and its responses (inventory B16-B18, F7).

Responses are built from all events and blocks, in every form that a service sends and in broken ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import features
from lectern.plans import views
from lectern.plans.feature_queries import WORDS
from lectern.plans.registry import query
from lectern.plans.text_queries import C, block_rows, events
from lectern.session import materialize
from lectern.sources import responses

#: Each form with the text or the error that it gives; E and U stand for the event's type and user.
FORMS = [
    ('{"output_text":"E","error":{"message":"x"}}', "E", None),
    ('{"output":[{"content":[{"text":"cU"}]}]}', "cU", None),
    ('{"choices":[{"message":{"content":"mU"}}]}', "mU", None),
    ('{"error":{"message":"x"},"output_text":" "}', None, 'error: {"message":"x"}'),
    ("broken{", None, "not JSON"),
    ('{"output":[{"type":"reasoning"},{"content":[{"text":" "},{"text":"sU"}]}]}', "sU", None),
    ('{"output":[{"content":[{"type":"refusal","refusal":"no"}]},{"text":"later"}]}', None, "refused: no"),
    ('{"status":"incomplete","incomplete_details":{"reason":"max_output_tokens"}}', None, 'incomplete: {"reason":"max_output_tokens"}'),
    ('{"output":[{"content":[{"json":{"k":[1,"E"]}}]}]}', '{"k":[1,"E"]}', None),
    ('{"output":["plain",{"content":["pU"]}]}', "pU", None),
    ('{"output":[{"type":"output_text","text":" oU","content":[{"text":"no"}]}]}', " oU", None),
    ('{"output":[{"text":"tU","content":[{"text":""}]}]}', "tU", None),
    ('{"choices":[{"message":{"content":[{"type":"x"},{"text":"lU"}]}}]}', "lU", None),
    ('{"choices":[{"message":{"content":" "},"text":"hU"}]}', "hU", None),
    ('{"error":{},"output_text":5}', None, "no text"),
    ('{"output":[{"type":"refusal"}],"choices":[{"text":"x"}]}', None, "refused: refusal"),
]


def filled(form):
    """A form as a column."""
    return F.replace(F.replace(F.lit(form), F.lit("E"), F.col("event_type")), F.lit("U"), F.col("user_id").cast("string"))


def chosen(column):
    """The event's form, or one of its results, as a column."""
    found = F.lit(None).cast("string")
    for k, form in enumerate(FORMS):
        if form[column] is not None:
            found = F.when(F.col("event_id") % len(FORMS) == k, filled(form[column])).otherwise(found)
    return found


def _case(column):
    return "CASE event_id % 16 " + " ".join(f"WHEN {k} THEN replace(replace('{form[column]}', 'E', event_type), 'U', user_id::VARCHAR)" for k, form in enumerate(FORMS) if form[column] is not None) + " END"


@query("b17_response_text", f"SELECT event_id, {_case(1)} AS text, {_case(2)} AS error FROM events")
def b17(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", responses.response_text(chosen(0)).alias("r")).select("event_id", "r.text", "r.error")


@query(
    "b18_payload",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Keywords' WHEN 1 THEN 'summary' ELSE 'tone' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN CASE event_id % 5 WHEN 0 THEN event_type || ',' || user_id WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END END AS items,
    CASE WHEN event_id % 3 = 1 THEN CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 's' || user_id WHEN 2 THEN 'v' || user_id WHEN 3 THEN '' END WHEN event_id % 3 = 2 THEN CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'v' || user_id WHEN 3 THEN '' END END AS value,
    CASE WHEN event_id % 5 = 4 THEN 'not a JSON object' END AS error FROM events""",
)
def b18(spark, sf_dir):
    """Lists of keywords (a number and a null among them), values, summaries, an empty object, and texts that are no objects, for three kinds."""
    text = "CASE event_id % 5 WHEN 0 THEN concat('{\"k\":[\"', event_type, '\",null,', user_id, ']}') WHEN 1 THEN concat('{\"k\":\"x\",\"s\":\"s', user_id, '\"}') WHEN 2 THEN concat('{\"s\":\"x\",\"v\":\"v', user_id, '\"}') WHEN 3 THEN '{}' ELSE IF(event_id % 2 = 0, 'oops', '[1]') END"
    n = F.col("event_id") % 3
    kind = F.when(n == 0, "Keywords").when(n == 1, "summary").otherwise("tone")
    found = events(spark, sf_dir).select("event_id", kind.alias("kind"), responses.payload(F.expr(text), kind).alias("p"))
    return found.select("event_id", "kind", F.array_join("p.items", ",").alias("items"), "p.value", "p.error")


TARGETS = f"n AS (SELECT *, {WORDS} AS words FROM blocks), tg AS (SELECT *, greatest(8, CAST(ceil(words * CAST(0.15 AS DOUBLE)) AS INT)) AS target FROM n)"


@query(
    "b16_token_budget",
    f"WITH {views.BLOCKS}, {TARGETS}, b AS (SELECT document_id, block_no, CASE WHEN block_no % 2 = 0 THEN 2048 ELSE least(greatest((target + 32) * 10, 2048), 4096) END AS budget FROM tg) SELECT document_id, block_no, budget, budget || ',8192' AS budgets FROM b",
)
def b16(spark, sf_dir):
    """Budgets of single requests, for keywords and for summaries in turn."""
    kind = F.when(F.col("block_no") % 2 == 0, "keywords").otherwise("summary")
    budget = features.token_budget(kind, tx.target_words(tx.word_count(F.col("text")), 0.15))
    return block_rows(spark, sf_dir).select("document_id", "block_no", budget.alias("budget")).withColumn("budgets", F.array_join(features.retry_budgets(F.col("budget")).cast("array<string>"), ","))


@query(
    "b16_batch_budget",
    f"WITH {views.BLOCKS}, {TARGETS}, bn AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY block_no) - 1) // 12 AS batch_no FROM tg) SELECT document_id, batch_no, CAST(greatest(2048, least(8192, (sum(target) + 20 * count(*) + 16 * count(*)) * 4)) AS INT) AS budget FROM bn GROUP BY 1, 2",
)
def b16_batch(spark, sf_dir):
    tasks = block_rows(spark, sf_dir).select("document_id", "block_no", tx.target_words(tx.word_count(F.col("text")), 0.15).alias("target"), F.lit(5).alias("most"))
    return features.batch_budgets(features.batches(tasks, ["document_id"], "block_no"), ["document_id", "batch_no"])


def answered(blocks):
    """A response to each block and kind: seven forms, three of them wrong; a tenth of the blocks gets a blank value."""
    n = F.col("block_no")
    first = F.slice(F.split("text", " "), 1, 8)
    blank = n % 10 == 9
    listed = F.when(blank, F.array(F.lit(" . "))).otherwise(first)
    said = F.when(blank, F.lit("  ")).otherwise(F.col("text"))
    keywords = F.to_json(F.struct(listed.alias("k")))
    summary = F.when(n % 2 == 0, F.to_json(F.struct(said.alias("v")))).otherwise(F.to_json(F.struct(said.alias("s"))))

    def wrapped(text):
        part = F.struct(text.alias("text"))
        return (
            F.when(n % 7 == 0, F.to_json(F.struct(text.alias("output_text"))))
            .when(n % 7 == 1, F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit(" ").alias("text"))).alias("content")), F.struct(F.array(part).alias("content"))).alias("output"))))
            .when(n % 7 == 2, F.concat(F.lit('{"output":[{"content":[{"json":'), text, F.lit("}]}]}")))
            .when(n % 7 == 3, F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))))
            .when(n % 7 == 4, F.lit('{"error":"busy"}'))
            .when(n % 7 == 5, F.lit('{"output":[{"content":[{"type":"refusal","refusal":"no"}]}]}'))
            .otherwise(F.lit('{"output_text":"sorry"}'))
        )

    kinds = F.array(F.struct(F.lit("keywords").alias("kind"), wrapped(keywords).alias("response")), F.struct(F.lit("summary").alias("kind"), wrapped(summary).alias("response")))
    return blocks.select("document_id", "block_no", F.explode(kinds).alias("r")).select("document_id", "block_no", "r.*")


GENERATED = rf"""{TARGETS},
kp AS (SELECT document_id, block_no, generate_subscripts(string_split(text, ' ')[1:8], 1) AS pos, trim(trim(regexp_replace(unnest(string_split(text, ' ')[1:8]), '\s+', ' ', 'g')), ' .,:;') AS k FROM n WHERE words > 20 AND block_no % 10 <> 9),
kf AS (SELECT document_id, block_no, lower(k) AS l, arg_min(k, pos) AS k, min(pos) AS pos FROM kp WHERE k <> '' GROUP BY 1, 2, 3),
kr AS (SELECT *, row_number() OVER (PARTITION BY document_id, block_no ORDER BY pos) AS nth FROM kf),
rk AS (SELECT document_id, block_no, 'keywords' AS kind, string_agg(k, ', ' ORDER BY nth) AS value FROM kr WHERE nth <= 5 GROUP BY 1, 2),
sw AS (SELECT document_id, block_no, {C} AS t, string_split({C}, ' ') AS w, greatest(target + 8, CAST(ceil(target * CAST(1.35 AS DOUBLE)) AS INT)) AS most FROM tg WHERE words > 35 AND block_no % 10 <> 9),
rs AS (SELECT document_id, block_no, 'summary' AS kind, CASE WHEN len(w) > most THEN rtrim(array_to_string(w[1:most], ' '), ' ,;:') || '...' ELSE t END AS value FROM sw),
er AS (SELECT document_id, block_no, kind, CASE block_no % 7 WHEN 4 THEN 'error: "busy"' WHEN 5 THEN 'refused: no' WHEN 6 THEN 'not a JSON object' END AS error FROM n JOIN (VALUES ('keywords', 20), ('summary', 35)) d(kind, least) ON words > least)"""


@query(
    "f7_from_responses",
    f"""WITH {views.BLOCKS}, {GENERATED}, gv AS (SELECT * FROM rk UNION ALL SELECT * FROM rs)
    SELECT er.document_id, er.block_no, er.kind, upper(er.kind[1]) || er.kind[2:] AS label, CASE WHEN error IS NULL THEN value END AS value, CASE er.kind WHEN 'keywords' THEN '#e8f5e9' ELSE '#e3f2fd' END AS color, CAST(CASE er.kind WHEN 'keywords' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS opacity, error
    FROM er LEFT JOIN gv ON gv.document_id = er.document_id AND gv.block_no = er.block_no AND gv.kind = er.kind WHERE error IS NOT NULL OR value IS NOT NULL""",
)
def f7_from_responses(spark, sf_dir):
    """Blocks, their tasks and the responses to them: keywords and summaries with the style of their definition."""
    blocks = materialize(block_rows(spark, sf_dir), "blocks")
    style = features.definitions(spark).withColumn("color", F.when(F.col("kind") == "keywords", "#e8f5e9").otherwise("#e3f2fd")).withColumn("opacity", F.when(F.col("kind") == "keywords", 1.0).otherwise(0.8))
    found = features.from_responses(blocks, style, answered(blocks), ["document_id", "block_no"])
    return found.select("document_id", "block_no", "kind", "label", "value", "color", "opacity", "error")
