"""The registered queries of this subpackage: thin (spark, sf_dir) -> DataFrame functions over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import prepare, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontaminate import find

    return find(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
     q AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
     qs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM q)),
     n AS (SELECT item_id, count(*) AS n_item FROM qs GROUP BY item_id),
     s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN qs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shared AS DOUBLE) / n_item AS containment, n_shared, n_item
FROM s JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.jaccard import join

    return join(table(prepare(spark), sf_dir, "documents"))


#: Word shingles of all pairs; the links are closed to components by recursion, so this is for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN chr(1) || text ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
     r AS (SELECT x, y FROM k UNION SELECT r.x, k.y FROM r JOIN k ON r.y = k.x)
SELECT n.doc_id, least(n.doc_id, coalesce((SELECT min(y) FROM r WHERE x = n.doc_id), n.doc_id)) AS class_id, (SELECT count(*) FROM k WHERE x = n.doc_id) AS n_links FROM n
"""

#: Terms, band and subsets as in the operator; ids are taken as distinct.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
     o AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), (SELECT max(doc_id) FROM d)) AS next_id FROM d),
     e AS (SELECT o.doc_id, o.next_id, o.text, o.n, substr(o.text, 1, o.n - o.n // 3) || substr(x.text, 1, o.n // 3) AS edited FROM o JOIN d x ON x.doc_id = o.next_id),
     t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
     m AS (SELECT DISTINCT doc_id, kind, term FROM (SELECT doc_id, kind, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM t) WHERE term <> ''),
     f AS (SELECT term, count(*) AS df FROM m WHERE kind = 0 GROUP BY 1),
     l AS (SELECT term FROM f WHERE df >= greatest(2, 0.0005 * (SELECT count(*) FROM d)) AND df <= greatest(2, 0.2 * (SELECT count(*) FROM d))),
     b AS (SELECT m.*, l.term IS NOT NULL AS inside, max(CASE WHEN l.term IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kind) AS told FROM m LEFT JOIN l USING (term)),
     h AS (SELECT doc_id, kind, term, md5(term) AS z FROM b WHERE inside OR told = 0),
     s AS (SELECT j, v, CASE WHEN v = 0 THEN 'g' ELSE lpad(format('{:x}', 4096 >> v), 3, '0') END AS top FROM (SELECT unnest(range(0, 6)) AS j), (SELECT unnest(range(0, 13)) AS v) WHERE v > 0 OR j = 0),
     q AS (SELECT doc_id, kind, j, v, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS s FROM h JOIN s ON substr(z, 3 * j + 1, 3) < top GROUP BY 1, 2, 3, 4),
     i AS (SELECT doc_id, kind, CASE WHEN v = 0 THEN -1 ELSE j END AS j, v, coalesce(s, '........') AS s FROM (SELECT t.doc_id, t.kind, s.j, s.v FROM t, s) LEFT JOIN q USING (doc_id, kind, j, v)),
     r AS (SELECT doc_id, kind, string_agg(s, '' ORDER BY j, v) AS print FROM i GROUP BY 1, 2),
     pr AS (SELECT doc_id, 0 AS what, doc_id AS other, 1 AS other_kind FROM e UNION ALL SELECT doc_id, 1, next_id, 0 FROM e),
     y AS (SELECT pr.doc_id, pr.what, count(*) FILTER (x.s = w.s AND x.s <> '........') AS same, count(*) FILTER (x.s <> '........' OR w.s <> '........') AS active FROM pr JOIN i x ON x.doc_id = pr.doc_id AND x.kind = 0 JOIN i w ON w.doc_id = pr.other AND w.kind = pr.other_kind AND w.j = x.j AND w.v = x.v GROUP BY 1, 2),
     u AS (SELECT doc_id, what, CASE WHEN active = 0 THEN 1.0 ELSE CAST(same AS DOUBLE) / active END AS near FROM y)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.print AS fingerprint, z.print AS edited_fingerprint, p.near AS near_edited, x.near AS near_next
FROM e JOIN r a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN r z ON z.doc_id = e.doc_id AND z.kind = 1 JOIN u p ON p.doc_id = e.doc_id AND p.what = 0 JOIN u x ON x.doc_id = e.doc_id AND x.what = 1
"""


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.imatch import compare_edited

    return compare_edited(table(prepare(spark), sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.language import identify, learn

    docs = table(prepare(spark), sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    model = learn(docs.where(remainder != 1))
    found = identify(docs, model)
    return found.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.tokens import count_tokens

    return count_tokens(table(prepare(spark), sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.urls import filter_urls

    return filter_urls(table(prepare(spark), sf_dir, "pages"), URL_RULES)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack

    return pack(table(prepare(spark), sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that toxicity may learn from."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import REJECT_AT, score

    found = score(table(prepare(spark), sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.linededup import remove_repeats

    found = remove_repeats(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("__removed").alias("lines_removed"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
     w AS (SELECT doc_id, i, line, length(line) - length(replace(line, ' ', '')) + 1 AS words, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
     r AS (SELECT doc_id, i, 1 AS k, line AS run FROM w WHERE words >= 40
           UNION ALL SELECT doc_id, i, 2, line || chr(10) || next FROM w WHERE next IS NOT NULL),
     f AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY k, run) AS first FROM r),
     m AS (SELECT DISTINCT doc_id, i + d AS i FROM (SELECT doc_id, i, unnest(range(0, k)) AS d FROM f WHERE (doc_id, i) <> first)),
     s AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM m),
     g AS (SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id, isle) AS total FROM s JOIN w USING (doc_id, i)),
     x AS (SELECT doc_id, i FROM g WHERE total >= 40),
     k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS text, count(x.i) AS gone FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars, CAST(gone AS INT) AS lines_removed FROM k
"""


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html import extract

    return extract(table(prepare(spark), sf_dir, "pages"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact import find

    return find(table(prepare(spark), sf_dir, "documents"), keep="largest")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d
"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.periodic import find_runs, made_periodic

    docs = table(prepare(spark), sf_dir, "documents")
    found = find_runs(docs.select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text")))
    return found.drop("n_words")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.whitening import whiten

    found = whiten(table(prepare(spark), sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard": op2_jaccard,
    "op3_imatch": op3_imatch,
    "op4_language": op4_language,
    "op5_tokens": op5_tokens,
    "op6_urls": op6_urls,
    "op7_pack": op7_pack,
    "op8_toxicity": op8_toxicity,
    "op9_lines": op9_lines,
    "op10_html": op10_html,
    "op11_exact": op11_exact,
    "op12_runs": op12_runs,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_jaccard": OP2_SQL, "op3_imatch": OP3_SQL, "op9_lines": OP9_SQL, "op11_exact": OP11_SQL}
