"""Repair of grouping output against the rules spelled out over plain lists."""

import json
import random
import re

from lectern.operators import grouping


def plain_merge(paragraphs, texts):
    """Neighbours merged while the whole text so far goes on in the next group."""
    merged = []
    text = lambda ids: " ".join(texts[i].strip() for i in ids if texts[i].strip())

    def goes_on(previous, current):
        a, b = text(previous[1]), text(current[1])
        if previous[2:] != current[2:] or not a or not b:
            return False
        if a.rstrip().endswith("-"):
            return True
        return not re.search(r"[.!?][\"')\]]*$", a) and bool(re.search(r"^[a-z,;:)\]\-]", b.lstrip()))

    for name, ids, path, role in paragraphs:
        if merged and goes_on(merged[-1], (name, ids, path, role)):
            merged[-1] = (merged[-1][0], list(dict.fromkeys(merged[-1][1] + ids)), path, role)
        else:
            merged.append((name, list(ids), path, role))
    return merged


def test_merge_of_overlapping_groups(spark):
    draw = random.Random(3)
    chunks, groups, expected = [], [], set()
    for document in range(80):
        texts = {f"c{k}": draw.choice(["end.", "goes on", "Then", "hy-", 'said."', " ", "and so", "X", "(a)", "b) c"]) for k in range(draw.randint(1, 14))}
        chunks += [(document, 0, c, k, t) for k, (c, t) in enumerate(texts.items())]
        own = []
        for ord_ in range(1, draw.randint(1, 9) + 1):
            ids = sorted(draw.sample(list(texts), draw.randint(1, min(4, len(texts)))), key=lambda c: int(c[1:]))
            own.append((f"g{ord_}", ids, draw.choice([["A"], ["A", "B"]]) if ord_ % 5 == 0 else ["A"], draw.choice(["body"] * 4 + ["caption"])))
            groups.append((document, ord_, f"g{ord_}", "", ids, own[-1][2], own[-1][3]))
        expected |= {(document, name, tuple(ids), tuple(path), role) for name, ids, path, role in plain_merge(own, texts)}
    table = spark.createDataFrame(chunks, "document_id long, window_no int, chunk_id string, reading_order int, text string")
    rows = spark.createDataFrame(groups, "document_id long, ord int, paragraph_id string, source_paragraph_id string, chunk_ids array<string>, section_path array<string>, role string")
    got = {(r["document_id"], r["paragraph_id"], tuple(r["chunk_ids"]), tuple(r["section_path"]), r["role"]) for r in grouping.merged(rows, table).collect()}
    assert got == expected and len(expected) < len(groups)


def test_output_of_a_window(spark):
    windows = spark.createDataFrame([(1, 0, f"c{k}", k, "t") for k in range(5)], "document_id long, window_no int, chunk_id string, reading_order int, text string")
    said = {
        "title": " T ",
        "paragraphs": [
            {"paragraph_id": " b?1 ", "chunk_ids": [" c4", "c3", "c4"], "section_path": [" S ", " "], "role": " Body-Text"},
            {"chunk_ids": [" "], "role": "x"},
            {"chunk_ids": ["c1"], "role": " "},
        ],
        "ignored_chunk_ids": ["c1", " c0 ", "c2", ""],
    }
    outputs = grouping.parse(spark.createDataFrame([(1, 0, json.dumps(said))], "document_id long, window_no int, j string"), "j")
    groups = grouping.clean(outputs, windows)
    assert [tuple(r)[2:] for r in groups.orderBy("position").collect()] == [(1, "paragraph-0002", ["c1"], [], "body"), (2, "b-1", ["c3", "c4"], ["S"], "body-text")]
    assert grouping.unknown_ids(outputs, windows).count() == 0
    assert [r["chunk_ids"] for r in grouping.ignored(outputs, groups, grouping.WINDOW).collect()] == [["c0", "c2"]]
    documents = spark.createDataFrame([(1, "own"), (2, " own ")], "document_id long, title string")
    assert {r["document_id"]: r["title"] for r in grouping.titles(outputs, documents).collect()} == {1: "T", 2: "own"}
    wrong = outputs.select("document_id", "window_no", "title", "paragraphs").selectExpr("*", "array('zz', 'c1') AS ignored_chunk_ids")
    unknown = grouping.unknown_ids(wrong, windows)
    assert [tuple(r) for r in unknown.collect()] == [(1, 0, None, "zz")] and grouping.without_errors(wrong, unknown).count() == 0
