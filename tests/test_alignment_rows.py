"""Alignment on numbers: tokens, blocks and stretches of the work, and what plans hold."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_alignment import brute, run_from, tokens

from lectern import plans
from lectern.functions import text as tx
from lectern.operators import alignment
from lectern.plans import views

ODD = ["", " ", "a", "a b a", "Éa1-b2_c", "ab", "cd", "İx y", "日本 x9", "…", "X\nx\tX", None, "A" * 300, "0 1 0", "😀a😀"]


def plan_of(spark, name):
    return plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d21_aligned_chunks", "d22_body_filter", "d20_alignment_runs"])
def test_no_token_is_a_row(spark, name):
    """Chunks and units meet once, as two rows of a document; tokens are neither exploded nor sorted as rows, and the work is done once."""
    plan = plan_of(spark, name)
    assert "xxhash64" not in plan and "regexp_extract_all(lower" not in plan
    assert len(re.findall(r"SortMergeJoin \[document_id#\d+L\],", plan)) == 1 == plan.count("ArrowEvalPython")
    assert plan.count("SortMergeJoin") == 1 + (name == "d22_body_filter")


def test_words_are_the_tokens_of_the_text(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, text string").select("n", tx.alignment_tokens(F.col("text")).alias("own"), F.lower("text").alias("text")).orderBy("n").collect()
    texts = pa.array([r["text"] or "" for r in rows], pa.string())
    for low in (0, 3):  # a slice begins inside the buffers
        of, words = alignment._words(texts[low:])
        found = [set() for _ in rows[low:]]
        for n, word in zip(of.tolist(), words.to_pylist()):
            found[n].add(word)
        assert found == [set(r["own"] or []) for r in rows[low:]]
    assert [len(x) for x in alignment._words(pa.array([], pa.string()))] == [0, 0]


def documents(count, seed=11):
    draw = random.Random(seed)
    for _ in range(count):
        of = "abcdefghijklmnop"[: draw.randint(3, 16)]
        words = lambda n: " ".join(draw.choice(of + "xyz") for _ in range(n))
        yield [words(draw.choice([0, 1, 2, 3, 6])) for _ in range(draw.randint(0, 30))], [words(draw.randint(0, 9)) for _ in range(draw.randint(0, 5))]


@pytest.mark.parametrize("stretch,block", [(4_000, 100_000), (1, 1), (40, 7)])
def test_blocks_and_stretches_change_nothing(monkeypatch, stretch, block):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = list(documents(60))
    lists = [pa.array([list(range(len(c))) for c, _ in docs], pa.list_(pa.int32())), *(pa.array([d[k] for d in docs], pa.list_(pa.string())) for k in (0, 1))]
    every = alignment._stretches(alignment._every)(*lists).to_pylist()
    chosen = alignment._stretches(alignment._chosen)(*lists).to_pylist()
    for (chunk_texts, unit_texts), by_unit, picked in zip(docs, every, chosen):
        own = [tokens(t) for t in chunk_texts]
        for text, runs in zip(unit_texts, by_unit, strict=True):
            unit = tokens(text)
            expected = [(s, *run_from(unit, own, s)) for s in range(len(own))] if unit else []
            assert [(r["start"], r["chunks"], r["coverage"]) for r in runs] == [e for e in expected if e[1]]
        assert [(p["unit"], p["start"], p["chunks"]) for p in picked] == brute(unit_texts, chunk_texts)
    assert len(alignment._stretches(alignment._every)(*(a[:0] for a in lists))) == 0


def test_frequent_words_make_no_pairs():
    """Chunks and units of a long document that share frequent words only aren't compared."""
    n = 3000
    chunks = pa.array([[f"the of and in own{k} its{k} new{k} way{k} end{k}" for k in range(n)]])
    units = pa.array([[f"the of and in own{k} its{k} new{k} way{k} end{k}" for k in range(0, n, 3)]])
    found = [np.stack(p, axis=1) for p in alignment._pairs(alignment._Tokens(chunks, units))]
    assert len(np.concatenate(found)) <= 2 * n


def test_null_texts_and_lone_documents(spark):
    chunks = spark.createDataFrame([(1, 0, None), (1, 1, "a b"), (2, 0, "a b"), (3, 0, None)], "document_id long, reading_order int, text string")
    units = spark.createDataFrame([(1, 4, "a b"), (1, 5, None), (3, 0, "a"), (9, 0, "a b")], "document_id long, unit_no int, text string")
    assert [tuple(r) for r in alignment.align(units, chunks).collect()] == [(1, 4, 0, [1])]
    assert sorted(tuple(r) for r in alignment.runs(units, chunks).collect()) == [(1, 4, 0, [1], 1.0), (1, 4, 1, [1], 1.0)]


def test_chosen_chunks_are_dealt_as_the_texts_are(spark):
    """The body filter joins chosen chunks with all chunks where these are."""
    found = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", plan_of(spark, "d22_body_filter"))
    assert len(found) == 4 and {(re.sub(r"#\d+L?", "", keys), n) for keys, n in found} == {("document_id", str(views.parts(spark, SMALL)))}


def test_lines_are_cut_at_every_twelfth_word(spark, tmp_path):
    lines = ["", " ", "a", " a  b ", " ".join("w%d" % k for k in range(24)), " ".join("w%d" % k for k in range(25)), "x" + " " * 30 + "y", "\tq\r z", "ü " * 13]
    texts = [*lines, "\n".join(lines), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["document_id"], r["reading_order"]): r["text"] for r in views.chunks(spark, str(tmp_path)).collect()}
    expected = {}
    for n, text in enumerate(texts):
        kept = [line.strip(" ").split(" ") for line in (text or "").split("\n") if line.strip(" ")]
        runs = [" ".join(ws[k : k + 12]) for ws in kept for k in range(0, len(ws), 12)]
        expected |= {(n, k): run for k, run in enumerate(runs)}
    assert found == expected


def test_words_of_a_line_are_no_list(spark):
    """A line is cut in one pass: its words are neither split nor joined one by one."""
    plan = views.chunks(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "array_join" not in plan and "slice(" not in plan
