from conftest import SMALL
from fixtures import documents, empty, prose
from oracle import check

from lectern.llm import decontaminate
from lectern.llm.queries import OP1_SQL, op1_decontaminate


def test_whole_table(spark):
    check(op1_decontaminate(spark, SMALL), OP1_SQL, SMALL)


def test_short_items_in_long_documents(spark):
    long = prose(50, 8000).split()
    items = [(1, " ".join(long[4000:4016])), (2, prose(51, 30)), (3, None), (4, "too few words"), (5, " ".join(long[100:140])), (5, " ".join(long[100:140]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(100, " ".join(long), None, None, 0, "", 0, "", 0.0, 0, 0)])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark).collect()}
    assert found == {(100, 1), (100, 5)}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.find(empty(spark), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    items = [(k, " ".join(prose(3, 120).split()[10 * k : 10 * k + 20])) for k in range(6)]
    found = decontaminate.find(documents(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["item_id"] for r in found.where("doc_id = 3").collect()} == set(range(6))


def test_items_of_few_shingles_are_always_found():
    """One to eight shingles, anywhere in many texts: nothing is left to chance."""
    texts = [prose(k, 60) for k in range(400)]
    items = [(k, " ".join(t.split()[k % 50 : k % 50 + 5 + k % 4])) for k, t in enumerate(texts)]
    own = decontaminate.Index(items, decontaminate.THRESHOLD, decontaminate.RECALL)
    assert set(map(len, own.short.values())) == {1} and not own.partitions
    for k, text in enumerate(texts):
        assert (k, 1 + k % 4, 1 + k % 4) in own.search(text)
    assert own.search(prose(5000, 80)) == []
