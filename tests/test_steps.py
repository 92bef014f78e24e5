"""Steps of folds and joins that must be worked out once."""

from conftest import SMALL
from pyspark.sql import functions as F

from lectern import plans
from lectern.functions import text as tx
from lectern.operators import overlays


def plan_of(frame, phase="optimizedPlan"):
    return getattr(frame._jdf.queryExecution(), phase)().toString()


def test_a_chunk_that_fits_is_told_once(spark):
    """The sentence's end is looked for in one place of the fold, not once for each field."""
    assert plan_of(plans.QUERIES["d5_layout_paragraphs"](spark, SMALL), "analyzed").count(tx.CONTINUATION_START) == 1


def test_white_space_of_a_lead_sentence_is_collapsed_once(spark):
    rows = spark.createDataFrame([("a  b. c",), (None,), ("  ",), ("x" * 70 + " " + "y" * 70,)], "text string")
    found = rows.select(tx.lead_sentence(F.col("text")).alias("s"))
    assert plan_of(found, "analyzed").count("regexp_replace(coalesce") == 1
    assert [r["s"] for r in found.collect()] == ["a b.", "summary pending", "summary pending", "x" * 70 + "..."]


def test_keywords_of_chunks_are_worked_out_once_and_blocks_stay(spark):
    """No filter on the keywords below the join; blocks without chunks, with unknown ones, with models on and with representations have a row."""
    assert plan_of(plans.QUERIES["g4_keyword_fallback"](spark, SMALL)).count("about") == 1
    chunks = spark.createDataFrame([(1, "c0", []), (1, "c1", ["a"]), (1, "c2", ["b"])], "document_id int, chunk_id string, keywords array<string>")
    blocks = [(1, "k", ["c0", "c2", "c1"], False), (1, "none", [], False), (1, "null", None, False), (1, "unknown", ["zz"], False), (1, "empty", ["c0"], False), (1, "has", ["c1"], True)]
    blocks = spark.createDataFrame(blocks, "document_id int, block_id string, chunk_ids array<string>, has_representations boolean")
    found = {r["block_id"]: r["keywords"] for r in overlays.keyword_fallback(blocks, chunks, F.col("document_id") == 2).collect()}
    assert found == {"k": ["b"], "none": None, "null": None, "unknown": None, "empty": None, "has": None}
    assert {r["keywords"] for r in overlays.keyword_fallback(blocks, chunks, F.col("document_id") == 1).select(F.col("keywords").cast("string")).collect()} == {None}


def test_paragraphs_of_a_workspace_are_worked_out_once(spark, monkeypatch):
    """Representations are made of the paragraphs that were written, and a chunk's text is not copied to its follower's row."""
    from lectern.operators import features, layout
    from lectern.plans import views

    seen, rows = [], features.default_rows
    monkeypatch.setattr(features, "default_rows", lambda blocks, keys: seen.append(plan_of(blocks)) or rows(blocks, keys))
    assert plans.QUERIES["a13_workspace_sinks"](spark, SMALL).count() == 5
    assert len(seen) == 1 and "Window" not in seen[0]
    assert "lag(text" not in plan_of(layout.reading_blocks(views.chunks(spark, SMALL)))


def test_white_space_is_collapsed_as_before(spark):
    import itertools

    texts = ["".join(t) for n in range(6) for t in itertools.product(" \n\u00a0a", repeat=n)] + ["a\u2003 b\u0085\tc", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    assert rows.where(~tx.collapse(F.col("text")).eqNullSafe(plain)).count() == 0


def test_the_end_and_start_of_texts_tell_what_both_texts_do(spark):
    texts = [None, "", " ", "a", "A", "so-", "so- ", "-", "done.", 'done."', "?)]", ", and", "1", "é", "b.\n", "x-\n"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    assert rows.where(~tx.goes_on(tx.sentence_end(F.col("a")), tx.sentence_start(F.col("b"))).eqNullSafe(tx.continues(F.col("a"), F.col("b")))).count() == 0


def test_a_response_is_parsed_once(spark):
    """Its JSON and that of its text, and neither below or in the join."""
    plan = plan_of(plans.QUERIES["f7_from_responses"](spark, SMALL))
    assert plan.count("parseJson") == 2
    assert not any("Join" in line and "parseJson" in line for line in plan.splitlines())


def test_an_outline_sorts_its_candidates_and_chunks_once(spark):
    """One sort of a document's title candidates, one of its chunks for its body font and paragraphs."""
    plan = plan_of(plans.QUERIES["d11_outline"](spark, SMALL), "executedPlan")
    first = [line.split("Sort [")[1] for line in plan.split("== Initial Plan ==")[0].splitlines() if "Sort [" in line]
    assert sum("DESC" in keys for keys in first) == 1
    assert not any(keys.startswith("document_id") and keys.count("ASC") == 1 for keys in first)


def test_pairs_of_regions_are_compared_once(spark):
    assert plan_of(plans.QUERIES["g8_best_layout"](spark, SMALL)).count("array_min(") == 2


def test_only_regions_that_could_win_are_paired(spark):
    """4,000 regions of one block, 8 million allowed pairs, of which few are scored."""
    columns = "b int, idx int, page_number int, y double, w double, h double, ord double, need_s double, need_k double"
    many = [(0, i, 1 + i // 40, i % 40 / 50, 300.0, 30.0 + i % 7, (1 + i // 40) * 100000.0 + i % 40 * 20.0 + i * 0.0001, 28.0, 23.0) for i in range(4000)]
    import time

    began = time.time()
    found = overlays.best_layout(spark.createDataFrame(many, columns), ["b"]).collect()
    assert len(found) == 1 and time.time() - began < 20


def test_the_best_layout_is_that_of_a_plain_loop(spark):
    """Random regions with ties, pages, sizes and places that are near or unknown."""
    import random

    draw = random.Random(5)
    columns = "b int, idx int, page_number int, y double, w double, h double, ord double, need_s double, need_k double"
    rows = []
    for b in range(300):
        for i in range(draw.randint(1, 9)):
            page, y = draw.randint(1, 3), draw.choice([0.1, 0.1005, 0.102, 0.5, 0.9])
            rows.append((b, i, page, None if b % 10 == 9 and i % 2 else y, draw.choice([50.0, 300.0]), draw.choice([5.0, 24.0, 29.0, 60.0, 300.0]), draw.choice([0.0, page * 100.0, page * 100000.0]) + y * 1000 + i * 0.0001, draw.choice([10.0, 28.0]), 23.0))

    def fit(r, need):
        return (10000.0 if need <= r[5] else 0.0) + 100 * min(r[5] / max(need, 1.0), 4.0) + r[4] * r[5] / 1000 - 40 * max(need - r[5], 0.0) - r[6] / 100

    def best(regions):
        pairs = []
        for s in regions:
            for k in regions:
                same = s[2] == k[2] and s[3] is not None and k[3] is not None and k[3] >= s[3] - 0.001
                if k[2] > s[2] or same:
                    score = fit(s, s[7] + 4 + s[8]) + 20 if s[1] == k[1] else fit(s, s[7]) + fit(k, k[8]) - 0.02 * abs(k[6] - s[6])
                    pairs.append((-round(score, 6), s[1], k[1]))
        return min(pairs)[1:] if pairs else None

    wanted = {b: best([r for r in rows if r[0] == b]) for b in range(300)}
    found = {r["b"]: (r["summary_at"], r["keywords_at"]) for r in overlays.best_layout(spark.createDataFrame(rows, columns), ["b"]).collect()}
    assert found == {b: w for b, w in wanted.items() if w} and len({a == k for a, k in found.values()}) == 2
