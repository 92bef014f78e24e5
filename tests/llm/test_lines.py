from conftest import SMALL
from fixtures import documents, empty, prose
from oracle import check

from lectern.llm import linededup
from lectern.llm.queries import OP9_SQL, op9_lines


def test_whole_table(spark):
    check(op9_lines(spark, SMALL), OP9_SQL, SMALL)


def test_passage_goes_from_all_but_its_first_place(spark):
    docs = documents(spark)
    found = linededup.remove_repeats(docs)
    assert found.columns == [*docs.columns, "__removed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[7]["text"] == before[7]
    assert rows[8]["text"] == "\n".join(before[8].split("\n")[:2]) and rows[8]["__removed"] == 4
    assert rows[3]["text"] == before[3] and rows[4]["text"] == ""  # one line, the same as in document 3
    assert linededup.remove_repeats(empty(spark)).count() == 0


def test_short_repeats_stay(spark):
    line = prose(1, 9)
    docs = spark.createDataFrame([(k, f"{prose(k, 20)}\n{line}\n{prose(k + 50, 20)}") for k in range(5)], "doc_id long, text string")
    assert all(r["__removed"] == 0 for r in linededup.remove_repeats(docs).collect())


def test_index_holds_what_decides(spark):
    """Chunks of more than two lines never mark a line that their pairs don't."""
    docs = spark.createDataFrame([(k, k, "\n".join(prose(j, 9) for j in range(30))) for k in range(2)], "__id long, __th long, __text string")
    assert {r["__k"] for r in linededup.runs(docs, 40).select("__k").distinct().collect()} == {2}
