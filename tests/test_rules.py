"""Golden cases of single rules, as literal rows."""

from pyspark.sql import functions as F

from lectern.functions import boxes
from lectern.functions import text as tx
from lectern.operators import features, layout, study, windows


def one(spark, value, **columns):
    frame = spark.range(1)
    for name, column in columns.items():
        frame = frame.withColumn(name, column)
    return frame.select(value.alias("v")).first()["v"]


def test_box_is_flipped_and_normalised(spark):
    box = boxes.normalise_box(boxes.parse_box(F.lit("[60, 680, 540, 720]")), F.lit(600.0), F.lit(800.0))
    found = one(spark, box)
    assert [round(found[c], 6) for c in ("x", "y", "width", "height")] == [0.1, 0.1, 0.8, 0.05]


def test_box_of_named_edges_and_bad_boxes(spark):
    assert one(spark, boxes.parse_box(F.lit('{"x1":1,"y1":2,"right":3,"t":4}'))).asDict() == {"l": 1.0, "b": 2.0, "r": 3.0, "t": 4.0}
    assert one(spark, boxes.parse_box(F.lit("[1,2,3]"))) is None
    assert one(spark, boxes.parse_box(F.lit("not json"))) is None


def test_targets_and_caps(spark):
    assert one(spark, tx.target_words(F.lit(60), 0.25)) == 15
    text = " ".join(f"w{k}" for k in range(40))
    assert one(spark, tx.cap_summary(F.lit(text), F.lit(15))) == " ".join(f"w{k}" for k in range(23)) + "..."
    assert one(spark, tx.clean_keywords(F.array(F.lit(" A b. "), F.lit("a  B"), F.lit(";"), F.lit("c")), 2)) == ["A b", "c"]


def test_text_rules(spark):
    assert one(spark, tx.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, tx.join_lines(F.array(F.lit("for-"), F.lit("mat the"), F.lit(" "), F.lit("Text-"), F.lit("Book")))) == "format the Text- Book"
    assert one(spark, tx.numbered(F.lit("A study of reading"))) is True  # a lone capital counts
    assert one(spark, tx.numbered_depth(F.lit("2.1.3 Deep"))) == 3
    assert one(spark, tx.continues(F.lit("ends so-"), F.lit("Next"))) is True
    assert one(spark, tx.continues(F.lit('it ended."'), F.lit("next"))) is False
    assert one(spark, tx.continues(F.lit("it goes"), F.lit("on"))) is True
    assert one(spark, tx.elapsed(F.lit(61))) == "1:01"
    assert one(spark, tx.kind_label(F.lit("key_points"))) == "Key Points"


def test_exactly_twenty_words_give_no_job(spark):
    blocks = spark.createDataFrame([(1, "b1", "word " * 20), (1, "b2", "word " * 21), (1, "b3", "word " * 36)], "document_id long, block_id string, text string")
    jobs = features.plan_jobs(blocks, features.definitions(spark))
    assert sorted(r["job_id"] for r in jobs.collect()) == ["b2:keywords", "b3:keywords", "b3:summary"]


def test_scoring_keeps_unanswered_as_null(spark):
    key = spark.createDataFrame([("q1", 0, 1), ("q2", 1, 0)], "question_id string, ordinal int, answer_index int")
    answers = spark.createDataFrame([("s", "q1", 0, 0), ("s", "q1", 1, 1), ("s", "q9", 2, 0), ("s", "q2", 3, None)], "session_id string, question_id string, pos int, selected_index int")
    row = study.score(answers, key).first()
    assert (row["correct"], row["total"], row["details"]) == (1, 2, "q1=1+,q2=null-")


def test_windows_of_two_and_last_state(spark):
    chunks = spark.createDataFrame([(1, k, 1, "x" * 10) for k in range(4)], "document_id long, reading_order int, page_number int, text string")
    assert sorted((r["reading_order"], r["window_no"]) for r in windows.pack_windows(chunks, size=2).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    sizes = windows.envelope(windows.pack_windows(spark.createDataFrame([(1, k, 1 if k < 18 else 2 if k < 30 else 3, "x") for k in range(40)], chunks.schema)))
    assert [r["size"] for r in sizes.orderBy("window_no").collect()] == [12, 6, 12, 10]


def test_columns_stay_apart(spark):
    rows = [(1, 1, n, x, y, 0.38, 0.02) for n, (x, y) in enumerate([(0.1, 0.1), (0.1, 0.2), (0.55, 0.1), (0.55, 0.2)])]
    chunks = spark.createDataFrame(rows, "document_id long, page_number int, reading_order int, x double, y double, width double, height double")
    assert {(r["x"], r["column_no"]) for r in layout.columns_of_page(chunks).collect()} == {(0.1, 0), (0.55, 1)}


def test_assignment_shares(spark):
    exams = spark.createDataFrame([("a", 1.0, 0), ("b", 3.0, 1), ("c", 0.0, 2)], "exam_id string, weight double, ordinal int")
    found = study.weighted_assignment(spark.range(4000).withColumnRenamed("id", "p"), exams, ["p"])
    counts = {r["exam_id"]: r["count"] for r in found.groupBy("exam_id").count().collect()}
    assert sum(counts.values()) == 4000 and "c" not in counts and abs(counts["b"] / 4000 - 0.75) < 0.03




def test_response_forms(spark):
    """Walks every element in order; what comes first, a text or a refusal, counts."""
    from lectern.sources import responses

    cases = {
        '{"output":[{"content":[{"text":"a"},{"type":"refusal"}]}]}': ("a", None),
        '{"output":[{"content":[{"type":"refusal","text":"why"},{"text":"a"}]}]}': (None, "refused: why"),
        '{"output":[{"content":[{"json":null},{"json":[1]}]}]}': ("[1]", None),
        '{"output":"x","choices":[{"text":" b "}]}': (" b ", None),
        '{"output":[{"type":"output_text","text":7}]}': (None, "no text"),
        '{"output_text":" ","status":"incomplete"}': (None, "incomplete: {}"),
        '{"error":"","choices":[null,{"message":{"content":[{"type":"refusal","refusal":"no"}]}}]}': (None, "refused: no"),
        "[]": (None, "no text"),
        "": (None, "not JSON"),
    }
    rows = spark.createDataFrame([(k, j) for k, j in enumerate([*cases, None])], "k int, j string")
    found = {r["k"]: tuple(r["r"]) for r in rows.select("k", responses.response_text(F.col("j")).alias("r")).collect()}
    assert [found[k] for k in range(len(cases))] == list(cases.values()) and found[len(cases)] == (None, "not JSON")


def test_markup_units(spark):
    """Nested units, references, comments, CDATA, quoted tags, left-out end tags, stray ones, and text without any markup."""
    from lectern.sources import markup

    cases = {
        "<TEI><text><body><div><head>One</head><p>a <hi>b</hi>c <note>n <p>inner</p></note> d</p></div></body></text></TEI>": [("head", "One"), ("p", "a b c n inner d"), ("p", "inner")],
        "<body><p>caf&#233; &#x41;&amp;#66; &nbsp; &#0;</p></body>": [("p", "café A&#66; &nbsp; &#0;")],
        "<body><p>x<!-- </p><p>no -->y<![CDATA[ <p>&lt; ]]></p></body>": [("p", "xy <p>&lt;")],
        '<BODY CLASS="a"><P title="a > b">one<P>two<b>three<p>four</BODY><p>after': [("p", "one"), ("p", "two three"), ("p", "four")],
        "<p>a</div>b</p> c <h2>d<br/>e</h2>": [("p", "a b"), ("h2", "d e")],
        "<body><div><p>in</div>out<p>next < 3</p></body>": [("p", "in"), ("p", "next < 3")],
        "<script>'<p>'</script><style><p></style>none": [],
        "<t:p>pre</t:p><p/>": [("p", "pre")],
        "": [],
    }
    rows = spark.createDataFrame([(k, h) for k, h in enumerate([*cases, None])], "k int, html string")
    found = {r["k"]: [tuple(u) for u in r["u"]] for r in rows.select("k", markup.elements(F.col("html"), markup.UNITS, "body").alias("u")).collect()}
    assert [found[k] for k in range(len(cases))] == list(cases.values()) and found[len(cases)] == []
    titles = {"<title> </title><TITLE lang='x'>A &amp; <i>b</i></TITLE>": "A & b", "<title></title>": None, "<m:title>t</m:title>": "t", "none": None}
    rows = spark.createDataFrame(list(enumerate(titles)), "k int, html string")
    assert [r["t"] for r in rows.select("k", markup.title(F.col("html")).alias("t")).orderBy("k").collect()] == list(titles.values())


def test_a_large_scheduler_gives_the_same_answers(spark):
    """100,000 items, looked up by buckets, against a search in the running sum; and a few items both ways."""
    import bisect
    import itertools

    weights = [float(k * 7 % 11 - 2) for k in range(100_000)]
    items = spark.createDataFrame([(f"e{k}", w, k) for k, w in enumerate(weights)], "exam_id string, weight double, ordinal int")
    there = items.where("ordinal % 10 <> 4").select("exam_id", "ordinal")
    people = spark.range(2000).withColumnRenamed("id", "p")
    found = {r["p"]: r["exam_id"] for r in study.weighted_assignment(people, items, ["p"], there).collect()}
    usable = [(k, w) for k, w in enumerate(weights) if w > 0 and k % 10 != 4]
    sums = list(itertools.accumulate(w for _, w in usable))
    draws = {r["p"]: r["u"] for r in people.withColumn("u", study.draw("p")).collect()}
    assert found == {p: f"e{usable[bisect.bisect_left(sums, u * sums[-1])][0]}" for p, u in draws.items()}
    few = items.where("ordinal < 40")
    once = {r["p"]: r["exam_id"] for r in study.weighted_assignment(people, few, ["p"]).collect()}
    least, study.FEW_ITEMS = study.FEW_ITEMS, 0
    try:
        assert {r["p"]: r["exam_id"] for r in study.weighted_assignment(people, few, ["p"]).collect()} == once and len(once) == 2000
    finally:
        study.FEW_ITEMS = least
    try:
        study.weighted_assignment(people, items.limit(0), ["p"])
        raise AssertionError("no exam is an error")
    except ValueError:
        pass


def test_many_definitions_give_the_jobs_of_a_few(spark):
    """Thresholds of a hundred definitions, looked up by buckets of word counts, against a plain comparison."""
    least = {f"k{n}": n * 53 % 5000 for n in range(100)}
    defs = spark.createDataFrame([(k, k != "k7", v) for k, v in least.items()], "kind string, enabled boolean, least_words int")
    sizes = [0, 1, 20, 21, 37, 160, 161, 999, 4095, 4096, 4100, 6000]
    blocks = spark.createDataFrame([(1, f"b{n}", "w " * n) for n in sizes], "document_id long, block_id string, text string")
    found = {(r["block_id"], r["kind"]) for r in features.plan_jobs(blocks, defs).collect()}
    assert found == {(f"b{n}", k) for n in sizes for k, v in least.items() if k != "k7" and n > max(v, 20)}
    few = defs.where("kind IN ('k1', 'k2')")
    assert {(r["block_id"], r["kind"]) for r in features.plan_jobs(blocks, few).collect()} == {x for x in found if x[1] in ("k1", "k2")}
    assert features.plan_jobs(blocks, defs.limit(0)).count() == 0
    headers = {r["document_id"]: (r["status"], r["total_jobs"]) for r in features.job_headers(spark.range(3).withColumnRenamed("id", "document_id"), features.plan_jobs(blocks, few)).collect()}
    assert headers == {0: ("complete", 0), 1: ("pending", len({x for x in found if x[1] in ("k1", "k2")})), 2: ("complete", 0)}


def test_files_of_a_study(spark, tmp_path):
    """Broken exam files are told apart, files are read in order, and no enabled exam is an error."""
    from lectern.sources import files

    texts = {"b two.json": '{\n "id": "B.json",\n "time_limit_seconds": 30\n}', "a+1.json": '{"enabled": false}', "c.json": "{\n 'no", "d.json": '[{"id": "D"}]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = study.in_order(files.exams(spark, f"{tmp_path}/*.json"), "file").orderBy("place").collect()
    assert [(r["exam_id"], r["enabled"], r["timing_mode"]) for r in found] == [("a-1", False, "stopwatch"), ("b", True, "countdown"), ("d", True, "stopwatch")]
    assert [r["file"].rsplit("/", 1)[1] for r in files.unreadable(spark, f"{tmp_path}/*.json").collect()] == ["c.json"]
    assert study.enabled_exams(files.exams(spark, f"{tmp_path}/*.json")).count() == 2
    try:
        study.enabled_exams(files.exams(spark, f"{tmp_path}/a*.json"))
        raise AssertionError("none is enabled")
    except ValueError:
        pass
    (tmp_path / "r" / "block 1").mkdir(parents=True)
    (tmp_path / "r" / "block 2").mkdir()
    (tmp_path / "r" / "block 1" / "keywords.json").write_text('{"representation": {"kind": "keywords", "value": "a, b", "items": ["a", "b"]}}')
    (tmp_path / "r" / "block 1" / "summary.json").write_text('{"block_id": "",\n "representation": {"kind": "summary", "text": "s"}}')
    (tmp_path / "r" / "block 2" / "summary.json").write_text('{"block_id": "own", "representation": {"kind": "summary"}}')
    (tmp_path / "r" / "block 2" / "tone.json").write_text('{"block_id": "own", "representation": null}')
    rows = {r["block_id"]: [x["kind"] for x in r["representations"]] for r in files.representations(spark, f"{tmp_path}/r/*/*.json").collect()}
    assert rows == {"block 1": ["keywords", "summary"], "own": ["summary"]}


def test_title_sql_knows_all_references(spark, tmp_path):
    """Quotes, apostrophes, numbers, unknown ones, references to references; blank, missing and second titles."""
    from oracle import check

    from lectern import plans

    titles = ["<title>say &quot;a&apos;s&quot;</title>", "<title>&#233;&#xE9; &nbsp; &amp;quot; &lt;b&gt;</title>", "<title> </title><title>second</title>", "<p>none</p>", "<title>x &quot;y</title>", "<title>&#0; &#xD800; a &amp b; c</title>"]
    rows = [(k, "u", f"<html><head>{t}</head><body><p>p</p></body></html>") for k, t in enumerate(titles * 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (part,) = (tmp_path / "made").glob("*.parquet")
    part.rename(tmp_path / "pages.parquet")
    check(plans.QUERIES["a6_title"](spark, str(tmp_path)), plans.ORACLES["a6_title"], str(tmp_path))
