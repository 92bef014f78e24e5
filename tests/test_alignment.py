"""Alignment of units with runs of chunks, against the rule spelled out over plain lists."""

import random
import re

from conftest import SMALL
from pyspark.sql import functions as F

from lectern.operators import alignment, layout
from lectern.plans import views
from lectern.plans.record_queries import units
from lectern.plans.text_queries import blocks_of


def tokens(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def run_from(unit, texts, start):
    """(chunks, coverage) of the run that a start finds."""
    seen, taken = set(), []
    for k in range(start, min(start + 8, len(texts))):
        if not texts[k]:
            continue
        if len(texts[k] & unit) / len(texts[k]) < 0.45:
            if taken:
                break
            continue
        taken.append(k)
        seen |= texts[k] & unit
        if len(seen) / len(unit) >= 0.8:
            break
    return taken, len(seen) / len(unit)


def brute(unit_texts, chunk_texts):
    """(unit, start, chunks) of the greedy alignment, over all starts."""
    texts, cursor, out = [tokens(t) for t in chunk_texts], 0, []
    for number, text in enumerate(unit_texts):
        unit = tokens(text)
        best, most = None, 0.0
        for start in range(cursor, len(texts)) if unit else ():
            taken, coverage = run_from(unit, texts, start)
            if coverage > most:
                best, most = (number, start, taken), coverage
            if coverage >= 0.8:
                break
        if most >= 0.45:
            out.append(best)
            cursor = best[2][-1] + 1
    return out


def frames(spark, unit_texts, chunk_texts):
    chunks = spark.createDataFrame([(1, k, f"c{k}", t) for k, t in enumerate(chunk_texts)], "document_id long, reading_order int, chunk_id string, text string")
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(unit_texts)], "document_id long, unit_no int, text string"), chunks


def aligned(spark, unit_texts, chunk_texts):
    return sorted((r["unit_no"], r["start"], r["chunks"]) for r in alignment.align(*frames(spark, unit_texts, chunk_texts)).collect())


def test_run_ends_where_enough_is_covered(spark):
    unit = "one two three four five six seven eight nine ten"
    pair = frames(spark, [unit], ["one two three four", "five six seven eight", "nine ten"])
    assert [tuple(r)[1:] for r in alignment.align(*pair).collect()] == [(0, 0, [0, 1])]
    first = alignment.runs(*pair).where("start = 0").first()
    assert (first["chunks"], first["coverage"]) == ([0, 1], 0.8)


def test_chunks_without_tokens_are_passed_over(spark):
    unit = "one two three four five six seven eight nine ten"
    pair = frames(spark, [unit], ["one two three four five six", "...", "seven eight nine ten"])
    row = alignment.runs(*pair).where("start = 0").first()
    assert (row["chunks"], row["coverage"]) == ([0, 2], 1.0)
    far = frames(spark, [unit], ["one two three", *["..."] * 7, "four five six seven eight nine ten"])
    assert alignment.runs(*far).where("start = 0").first()["chunks"] == [0]  # the window counts all chunks


def test_a_start_among_misses_is_a_candidate(spark):
    """On equal coverage the earliest start wins, and its window ends earlier."""
    texts = ["x y", "a b c d e", *["a"] * 7]
    assert aligned(spark, ["a b c d e f g h i j"], texts) == [(0, 0, [1, 2, 3, 4, 5, 6, 7])] == brute(["a b c d e f g h i j"], texts)
    starts = {r["start"]: r["chunks"] for r in alignment.runs(*frames(spark, ["a b c d e f g h i j"], texts)).collect()}
    assert starts[1] == [*range(1, 9)] and starts[0] == [*range(1, 8)]


def test_cursor_moves_past_a_match(spark):
    texts = ["alpha beta gamma", "delta epsilon", "alpha beta gamma", "zeta"]
    assert aligned(spark, ["alpha beta gamma", "alpha beta gamma", "nothing here"], texts) == [(0, 0, [0]), (1, 1, [2])]


def test_random_documents(spark):
    draw = random.Random(7)
    words = lambda n, of: " ".join(draw.choice(of) for _ in range(n))
    rows, expected = ([], []), set()
    for document in range(60):
        of = "abcdefghijklmno"[: draw.randint(3, 15)]
        unit_texts = [words(draw.randint(0, 9), of) for _ in range(6)]
        chunk_texts = [words(draw.choice([0, 1, 2, 3, 6]), of + "xyz") for _ in range(draw.randint(1, 40))]
        rows[0].extend((document, k, t) for k, t in enumerate(unit_texts))
        rows[1].extend((document, k, t) for k, t in enumerate(chunk_texts))
        expected |= {(document, k, start, tuple(taken)) for k, start, taken in brute(unit_texts, chunk_texts)}
    pair = spark.createDataFrame(rows[0], "document_id long, unit_no int, text string"), spark.createDataFrame(rows[1], "document_id long, reading_order int, text string")
    assert {(r[0], r[1], r[2], tuple(r[3])) for r in alignment.align(*pair).collect()} == expected


def test_whole_table(spark):
    chunks = views.chunks(spark, SMALL).cache()
    wanted = units(blocks_of(chunks)).cache()
    by_unit, by_chunk = {}, {}
    for r in wanted.orderBy("unit_no").collect():
        by_unit.setdefault(r["document_id"], []).append((r["unit_no"], r["text"]))
    for r in chunks.orderBy("reading_order").collect():
        by_chunk.setdefault(r["document_id"], []).append(r["text"])
    expected = set()
    for document, own in by_unit.items():
        numbers = [n for n, _ in own]
        expected |= {(document, numbers[k], start, tuple(taken)) for k, start, taken in brute([t for _, t in own], by_chunk[document])}
    assert {(r[0], r[1], r[2], tuple(r[3])) for r in alignment.align(wanted, chunks).collect()} == expected
    assert alignment.runs(wanted, chunks).where(F.col("coverage") <= 0).count() == 0


def test_body_filter_leaves_front_and_references_out(spark):
    texts = ["A title of some paper", "Someone, Some University", "1 Introduction", "This body paragraph should remain.", "References", "[1] Another author. Another title."]
    units_, chunks = frames(spark, ["1 Introduction", "This body paragraph should remain."], texts)
    chunks = chunks.withColumn("page_number", F.floor(F.col("reading_order") / 2).cast("int") + 1)
    pages = {r["page_number"]: r for r in layout.body_only(chunks, alignment.selected_chunks(alignment.align(units_, chunks))).collect()}
    assert {k: r["chunk_ids"] for k, r in pages.items()} == {1: [], 2: ["c2", "c3"], 3: []} and pages[1]["error"] is None
    nothing = layout.body_only(chunks, alignment.selected_chunks(alignment.align(units_.where("unit_no > 5"), chunks))).collect()
    assert [(r["chunk_ids"], r["error"]) for r in nothing] == [([], "nothing of the body was found")] * 3
