"""Queries of grouping output and its repair (inventory C7, E3, E5, E7, E8, E9).

Outputs are what a model might give for the blocks of all documents, four blocks a window: out of order, padded and repeated ids, blank groups, roles and
paths, ids that overlap the block before, ignore lists that name used chunks, and windows that name unknown ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import grouping
from lectern.operators.layout import reading_blocks
from lectern.plans import views
from lectern.plans.registry import query
from lectern.session import materialize


def by_document(rows, label):
    """A written table dealt by document: what is keyed by a document and more needs no exchange after that."""
    return materialize(rows, label).repartition("document_id")


def grouped(spark, sf_dir):
    """(outputs, windows, documents) of all documents."""
    n, w = F.col("block_no"), F.floor(F.col("block_no") / 4).cast("int")
    chunks = reading_blocks(views.chunks(spark, sf_dir)).withColumn("window_no", w)
    windows = by_document(chunks.select("document_id", "block_no", "window_no", "chunk_id", "reading_order", "text"), "windows")
    listed = F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id")))
    blocks = windows.groupBy("document_id", "block_no").agg(F.first("window_no").alias("window_no"), F.transform(listed, lambda x: x["chunk_id"]).alias("chunk_ids"))
    before = F.lag(F.element_at("chunk_ids", -1)).over(Window.partitionBy("document_id", "window_no").orderBy("block_no"))
    rows = blocks.withColumn("before", before)
    ids = F.col("chunk_ids")
    shared = F.when((n % 3 == 1) & F.col("before").isNotNull(), F.array(F.col("before"))).otherwise(F.array().cast("array<string>"))
    padded = F.concat(F.reverse(ids), F.transform(F.slice(ids, 1, 1), lambda c: F.concat(F.lit(" "), c, F.lit(" "))), F.array(F.lit(" ")), shared)
    padded = F.when((w % 6 == 5) & (n % 4 == 2), F.concat(padded, F.array(F.lit("zz")))).otherwise(padded)
    path = F.when(n % 7 == 0, F.array(F.lit(" S "), F.lit(" "), n.cast("string"))).otherwise(F.array().cast("array<string>"))
    name = F.when(n % 2 == 0, F.concat(F.lit(" p "), n.cast("string"), F.lit("."))).otherwise(" ")
    role = F.when(n % 11 == 0, " Caption ").when(n % 2 == 0, " ")
    paragraph = F.struct(name.alias("paragraph_id"), F.when(n % 5 == 4, F.array(F.lit(" "))).otherwise(padded).alias("chunk_ids"), path.alias("section_path"), role.alias("role"))
    left_out = F.when(n % 5 == 4, F.concat(ids, F.array(F.lit("yy")))).otherwise(F.slice(ids, 1, 1))
    left_out = F.when((n % 5 == 4) & (w % 6 != 3), ids).otherwise(left_out)
    listed = F.array_sort(F.collect_list(F.struct((-n).alias("k"), paragraph.alias("p"), left_out.alias("i"))))
    outputs = rows.groupBy("document_id", "window_no").agg(listed.alias("s"))
    title = F.when(F.col("window_no") % 3 == 0, F.concat(F.lit(" T"), F.col("window_no").cast("string"))).otherwise(" ")
    outputs = outputs.select("document_id", "window_no", title.alias("title"), F.transform("s", lambda x: x["p"]).alias("paragraphs"), F.flatten(F.transform("s", lambda x: x["i"])).alias("ignored_chunk_ids"))
    documents = windows.select("document_id").distinct().withColumn("title", F.concat(F.lit("D"), F.col("document_id").cast("string")))
    return by_document(outputs, "outputs"), windows, documents


def repaired(spark, sf_dir):
    """(valid outputs, windows, documents, numbered groups)."""
    outputs, windows, documents = grouped(spark, sf_dir)
    valid = grouping.without_errors(outputs, grouping.unknown_ids(outputs, windows))
    return valid, windows, documents, by_document(grouping.numbered(grouping.clean(valid, windows)), "groups")


GROUPS = f"""{views.BLOCKS.strip()},
gb AS (SELECT document_id, block_no AS n, block_no // 4 AS w, chunk_ids, lag(chunk_ids[len(chunk_ids)]) OVER (PARTITION BY document_id, block_no // 4 ORDER BY block_no) AS before FROM blocks),
un AS (SELECT document_id, w, CAST(row_number() OVER (PARTITION BY document_id, w ORDER BY n DESC) - 1 AS INT) AS item, n FROM gb),
bad AS (SELECT document_id, CAST(w AS INT) AS window_no, item, 'zz' AS chunk_id FROM un WHERE w % 6 = 5 AND n % 4 = 2 AND n % 5 <> 4 UNION SELECT document_id, CAST(w AS INT), NULL, 'yy' FROM un WHERE w % 6 = 3 AND n % 5 = 4),
ok AS (SELECT gb.* FROM gb WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.document_id = gb.document_id AND bad.window_no = gb.w)),
gr AS (SELECT document_id, n, w, CASE WHEN n % 3 = 1 AND before IS NOT NULL THEN list_concat([before], chunk_ids) ELSE chunk_ids END AS ids, CASE WHEN n % 7 = 0 THEN ['S', n::VARCHAR] END AS path, CASE WHEN n % 11 = 0 THEN 'caption' ELSE 'body' END AS role,
 CASE WHEN n % 2 = 0 THEN 'p-' || n ELSE 'paragraph-' || lpad(CAST(count(*) OVER (PARTITION BY document_id, w ORDER BY n DESC) AS VARCHAR), 4, '0') END AS source FROM ok WHERE n % 5 <> 4),
sorted AS (SELECT *, CAST(substr(ids[1], 2) AS INT) AS first FROM gr),
nb AS (SELECT *, row_number() OVER (PARTITION BY document_id, w ORDER BY first, n DESC) AS position, row_number() OVER (PARTITION BY document_id ORDER BY w, first, n DESC) AS ord FROM sorted),
num AS (SELECT *, coalesce(last_value(path IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord), []) AS filled FROM nb)"""
CALLED = "'paragraph-' || lpad(CAST(ord AS VARCHAR), 4, '0')"


def flat(frame, *columns):
    for c in columns:
        frame = frame.withColumn(c, F.array_join(c, ","))
    return frame


@query("c7_unknown_ids", f"WITH {GROUPS} SELECT * FROM bad")
def c7(spark, sf_dir):
    """Unknown ids of groups (with the group's place) and of ignore lists."""
    outputs, windows, _ = grouped(spark, sf_dir)
    return grouping.unknown_ids(outputs, windows)


@query("e5_clean_groups", f"WITH {GROUPS} SELECT document_id, CAST(w AS INT) AS window_no, position, source AS paragraph_id, array_to_string(ids, ',') AS chunk_ids, coalesce(array_to_string(path, ','), '') AS section_path, role FROM num")
def e5(spark, sf_dir):
    outputs, windows, _ = grouped(spark, sf_dir)
    return flat(grouping.clean(grouping.without_errors(outputs, grouping.unknown_ids(outputs, windows)), windows), "chunk_ids", "section_path")


IGNORED = "used AS (SELECT DISTINCT document_id, w, unnest(ids) AS c FROM num), ign AS (SELECT DISTINCT document_id, w, unnest(CASE WHEN n % 5 = 4 THEN chunk_ids ELSE chunk_ids[1:1] END) AS c FROM ok)"


@query("e5_ignored", f"WITH {GROUPS}, {IGNORED} SELECT document_id, CAST(w AS INT) AS window_no, string_agg(c, ',' ORDER BY c) AS chunk_ids FROM ign ANTI JOIN used USING (document_id, w, c) GROUP BY 1, 2")
def e5_ignored(spark, sf_dir):
    """The ignore list of each window, less what its groups use."""
    valid, _, _, groups = repaired(spark, sf_dir)
    return flat(grouping.ignored(valid, groups, grouping.WINDOW), "chunk_ids")


@query("e3_envelope", f"WITH {GROUPS}, wl AS (SELECT document_id, w, string_agg(x.c, ',' ORDER BY CAST(substr(x.c, 2) AS INT)) AS chunk_ids FROM (SELECT document_id, w, unnest(chunk_ids) AS c FROM gb) x GROUP BY 1, 2) SELECT document_id, CAST(w AS INT) AS window_no, row_number() OVER (PARTITION BY document_id ORDER BY w) AS index, CAST(count(*) OVER (PARTITION BY document_id) AS INT) AS count, 'D' || document_id AS title, coalesce((SELECT array_to_string(arg_max(filled, ord), ',') FROM num WHERE num.document_id = wl.document_id AND num.w < wl.w), '') AS previous_section_path, chunk_ids FROM wl")
def e3(spark, sf_dir):
    _, windows, documents, groups = repaired(spark, sf_dir)
    return flat(grouping.envelopes(windows, groups, documents), "previous_section_path", "chunk_ids")


@query("e7_renumber", f"WITH {GROUPS}, tt AS (SELECT document_id, max(w) AS w FROM ok WHERE w % 3 = 0 GROUP BY 1) SELECT document_id, {CALLED} AS paragraph_id, source AS source_paragraph_id, array_to_string(filled, ',') AS section_path, coalesce('T' || tt.w, 'D' || document_id) AS title FROM num LEFT JOIN tt USING (document_id)")
def e7(spark, sf_dir):
    """Groups numbered over all windows, with their own ids, filled paths and the document's title."""
    valid, _, documents, groups = repaired(spark, sf_dir)
    joined = groups.join(grouping.titles(valid, documents).hint("merge"), "document_id")
    return flat(joined, "section_path").select("document_id", "paragraph_id", "source_paragraph_id", "section_path", "title")


#: One group of every document a round: the ids put together so far, whose last text goes on or not.
MERGED = f"""{GROUPS}, tx AS (SELECT document_id, list(text ORDER BY reading_order) AS texts FROM chunks GROUP BY 1),
 ng AS (SELECT num.*, texts FROM num JOIN tx USING (document_id)),
 mg AS (SELECT document_id, ord, ord AS head, ids, filled, role FROM ng WHERE ord = 1
  UNION ALL SELECT document_id, ord, CASE WHEN joins THEN head ELSE ord END, CASE WHEN joins THEN list_concat(old, list_filter(ids, lambda x: NOT list_contains(old, x))) ELSE ids END, filled, role
  FROM (SELECT *, filled = was AND role = old_role AND ({views.CONTINUES}) AS joins FROM (SELECT ng.document_id, ng.ord, ng.ids, ng.filled, ng.role, mg.head, mg.ids AS old, mg.filled AS was, mg.role AS old_role, texts[CAST(substr(mg.ids[len(mg.ids)], 2) AS INT) + 1] AS a, texts[CAST(substr(ng.ids[1], 2) AS INT) + 1] AS b FROM mg JOIN ng ON ng.document_id = mg.document_id AND ng.ord = mg.ord + 1))),
 whole AS (SELECT document_id, head, arg_max(ids, ord) AS ids, any_value(filled) AS filled, any_value(role) AS role FROM mg GROUP BY 1, 2)"""


@query("e8_overlapping_groups", f"WITH RECURSIVE {MERGED} SELECT document_id, 'paragraph-' || lpad(CAST(head AS VARCHAR), 4, '0') AS paragraph_id, source AS source_paragraph_id, array_to_string(whole.ids, ',') AS chunk_ids, array_to_string(whole.filled, ',') AS section_path, whole.role FROM whole JOIN (SELECT document_id, ord AS head, source FROM num) USING (document_id, head)")
def e8_overlapping(spark, sf_dir):
    """Groups that share chunks, put together where a sentence goes on: the merged ids."""
    _, windows, _, groups = repaired(spark, sf_dir)
    return flat(grouping.merged(groups, windows), "chunk_ids", "section_path")


@query("e9_metrics", f"WITH RECURSIVE {MERGED}, {IGNORED}, du AS (SELECT DISTINCT document_id, c FROM used), di AS (SELECT DISTINCT document_id, c FROM ign ANTI JOIN du USING (document_id, c)) SELECT document_id, (SELECT count(*) FROM whole WHERE whole.document_id = d.document_id) AS paragraph_count, (SELECT count(*) FROM di WHERE di.document_id = d.document_id) AS ignored_chunk_count, n AS semantic_window_count FROM (SELECT document_id, count(DISTINCT w) AS n FROM gb GROUP BY 1) d")
def e9(spark, sf_dir):
    valid, windows, _, groups = repaired(spark, sf_dir)
    paragraphs = grouping.merged(groups, windows)
    return grouping.metrics(paragraphs, grouping.ignored(valid, paragraphs, ["document_id"]), windows)
