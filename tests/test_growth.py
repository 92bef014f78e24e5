"""What must not grow with the tables: files on disk for each record, rows and steps of a plan."""

import glob

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lectern import plans
from lectern.session import shared_dir


@pytest.mark.parametrize("name, label", [("a9_exam_catalogue", "exams"), ("a11_representation_files", "representations")])
def test_files_on_disk_do_not_grow_with_participants(spark, name, label):
    folder = f"{shared_dir(spark).removeprefix('file:').replace('//', '/')}/lectern-{label}-*"
    before = set(glob.glob(f"{folder}/**/part-*", recursive=True))
    assert plans.QUERIES[name](spark, SMALL).count() > 0
    made = set(glob.glob(f"{folder}/**/part-*", recursive=True)) - before
    people = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert 0 < len(made) <= 2 * spark.sparkContext.defaultParallelism < people


def test_packed_files_are_read_as_files_are(spark, tmp_path):
    """Objects, lists, files that are no JSON, wrong types, empty ones and entries that are none."""
    from lectern.sources import files

    texts = ['{"id": "a",\n "questions": [{"text": "t", "answer_index": 1}]}', '[{"id": "b"}, {"id": "c", "enabled": false}]', '{\n "no', '[{"id": "d"}, {"id": ', "", " \n", "[]", '{"id": "e", "enabled": "soon"}', '[{"id": "f", "enabled": "soon"}, {"id": "g"}]', "7", '  [{"id": {"x": 1}, "time_limit_seconds": 5}]']
    for k, text in enumerate(texts):
        (tmp_path / f"f{k:02d}").mkdir()
        (tmp_path / f"f{k:02d}" / "exam.json").write_text(text)
    packed = spark.createDataFrame([(f"f{k:02d}/exam.json", t) for k, t in enumerate(texts)], "file string, text string")

    def read(frame):
        named = files.exam_rows(frame, files.folder(F.col("file"))).withColumn("file", F.regexp_extract("file", "f[0-9]+/exam.json$", 0))
        return sorted(map(str, named.collect()))

    found = read(files.packed_json(packed, files.EXAM))
    assert found == read(files.json_files(spark, f"{tmp_path}/*/*.json", files.EXAM)) and len(found) >= 4


def test_keywords_are_those_of_a_plain_count(spark):
    """Repeats, ties, stop words and words that begin like one, characters whose small letters are ASCII, and long texts; and no token is ranked that occurs once."""
    import re
    from collections import Counter

    from lectern.operators import features

    words = "About about abouts about-face 1about 'about from froma the The the- a-b a--b x1's İab KKelvin Kab these ab abc Abc".split()
    texts = [" ".join(words[(k * j * j) % len(words)] for j in range(n)) for k in range(1, 24) for n in (1, 3, 9, 60)] + ["", "these with", "ba ba bab", None, "w é wé Éwww", " ".join(f"w{k % 700}" for k in range(5000))]

    def plain(text):
        tokens = [t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9'-]{2,}", text or "")]
        places = Counter(t for t in tokens if t not in features.STOP_WORDS)
        best = sorted(places, key=lambda t: (-places[t], tokens.index(t)))
        return lambda count: [t.replace("-", " ") for t in best[:count]] or ["keyword pending"]

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for count in (1, 3, 5):
        found = {r["id"]: r["k"] for r in rows.select("id", features.keywords_of(F.col("text"), count).alias("k")).collect()}
        assert found == {k: plain(t)(count) for k, t in enumerate(texts)}
    plan = rows.select(features.keywords_of(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert "array_sort" not in plan and "arraysort" not in plan
