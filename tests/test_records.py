"""Golden cases of markup, nested records, exams, chips, profiles and settings."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import features, overlays, settings, study, windows
from lectern.sources import elements, markup


def test_text_of_inline_markup_belongs_to_its_unit(spark):
    xml = '<TEI><front><p>no</p></front><text><body n="1"><div><head>A <hi>bold</hi> head</head><p>One <ref>two</ref>\n three &amp; <b>four</b>.</p><p> </p></div></body><body><p>no</p></body></text></TEI>'
    html = "<html><body><h1>T</h1><p>open<p>next <br>line</p>gap<h2>H</h2></body></html>"
    found = [(r["i"], r["tag"], r["text"]) for r in markup.roles(markup.body_units(spark.createDataFrame([(1, xml), (2, html), (3, ""), (4, None)], "i int, x string"), "i", "x")).orderBy("i", "unit_no").collect()]
    assert found == [(1, "head", "A bold head"), (1, "p", "One two three & four ."), (2, "h1", "T"), (2, "p", "open"), (2, "p", "next line"), (2, "h2", "H")]


def test_deep_trees_are_read_to_the_end(spark):
    json = '{"type":"paragraph","content":"leaf"}'
    for _ in range(70):
        json = '{"kids":[' + json + "]}"
    rows = elements.walk(spark.createDataFrame([(1, json), (2, "broken{"), (3, None)], "i int, j string"), "i", "j").collect()
    assert [(r["i"], r["content"]) for r in rows] == [(1, "leaf")]


def test_one_choice_is_kept_and_none_gets_two(spark):
    schema = "id string, fallback_id string, document_id string, title string, question_set_id string, enabled boolean, timing_mode string, time_limit_seconds string, condition_id string, visible array<string>, questions array<struct<text:string,choices:array<string>,answer_index:int>>"
    rows = [("a/My Exam.json", "f", None, None, None, None, None, "90", None, None, [("Q", ["only"], 5), None, (None, [" "], -1), ("R", None, 1)])]
    exam = study.normalise_exams(spark.createDataFrame(rows, schema)).first()
    assert (exam["exam_id"], exam["title"], exam["question_set_id"], exam["enabled"], exam["timing_mode"], exam["time_limit_seconds"], exam["condition_id"]) == ("my-exam", "my-exam", "my-exam-questions", True, "countdown", 90, "none")
    assert [tuple(q) for q in exam["questions"]] == [("my-exam-q1", "Q", ["only"], 0), ("my-exam-q3", "Question 3", ["Choice 1", "Choice 2"], 0), ("my-exam-q4", "R", ["Choice 1", "Choice 2"], 1)]


def test_empty_items_have_no_chip(spark):
    items = F.array(*map(F.lit, ["", "a" * 15, "", "b" * 15]))
    rows = spark.range(1).select(overlays.chips_height(items, F.lit(300.0)).alias("a"), overlays.chips_height(items, F.lit(200.0)).alias("b"), overlays.chips_height(F.array(F.lit("")), F.lit(9.0)).alias("c")).first()
    assert tuple(rows) == (23.0, 50.0, 23.0)


def test_profiles(spark):
    pairs = [("v|provider=p|semantic=llm|model=m", "v|provider=p|semantic=llm|semantic_model=m", True), ("v|provider=p|semantic=llm|semantic_model=n|model=m", "v|provider=p|semantic=llm|semantic_model=m", False), ("v|provider=p|semantic=heuristic", "v|provider=p|semantic=heuristic|semantic_model=none", True), ("", "v|provider=p|semantic=heuristic", False), (None, "v", False), ("", "", True), ("w|provider=p|semantic=heuristic", "v|provider=p|semantic=heuristic", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean").select(settings.profile_matches(F.col("a"), F.col("b")).alias("found"), "same").collect()
    assert all(r["found"] == r["same"] for r in rows)


def test_failed_windows_are_halved_to_the_end(spark):
    rows = spark.createDataFrame([(1, k, 0, 100) for k in range(5)], "document_id long, reading_order int, window_no int, n_chars int")
    parts = {r["reading_order"]: (r["part"], r["failed"]) for r in windows.split_overflow(rows, lambda chars, size: chars > 150).collect()}
    assert parts == {0: ("00", False), 1: ("01", False), 2: ("10", False), 3: ("110", False), 4: ("111", False)}
    alone = {(r["part"], r["failed"]) for r in windows.split_overflow(rows, lambda chars, size: chars > 50).collect()}
    assert all(failed for _, failed in alone) and len(alone) == 5


def test_tables_of_settings_are_bounded(spark):
    with pytest.raises(ValueError):
        settings.fixed_rows(spark.range(settings.MOST_FIXED + 1))


def test_tables_written_again_replace_only_their_documents(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a") for k in range(50)], "document_id long, v string")
    elements.write_tables({"t": rows}, str(tmp_path))
    again = rows.where("document_id = 7").withColumn("v", F.lit("b"))
    elements.write_documents({"t": again}, str(tmp_path))
    found = {r["document_id"]: r["v"] for r in elements.read_table(spark, str(tmp_path), "t").collect()}
    assert found == {k: "b" if k == 7 else "a" for k in range(50)}


def test_keywords_in_the_row(spark):
    text = "Zeta alpha beta alpha gamma-ray zeta delta gamma-ray the ab about"
    row = spark.range(1).select(features.keywords_of(F.lit(text)).alias("k"), features.keywords_of(F.lit("")).alias("e"), features.keywords_of(F.lit(None).cast("string")).alias("n")).first()
    assert row["k"] == ["zeta", "alpha", "gamma ray"] and row["e"] == row["n"] == ["keyword pending"]
