import hashlib

import pytest
from conftest import SMALL
from fixtures import documents, empty, prose
from oracle import check
from pyspark.sql import functions as F

from lectern.llm import exact
from lectern.llm.queries import OP11_SQL, op11_exact


def test_whole_table(spark):
    check(op11_exact(spark, SMALL), OP11_SQL, SMALL)


def plainly(rows, keep):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    best = lambda ids: keep([i for i in ids if i is not None], default=None)
    return sorted(((i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("cell_bytes", [exact.CELL_BYTES, 1])
def test_groups(spark, keep, cell_bytes):
    """Awkward rows, and every repeated text dealt to cells as if it were heavy."""
    hot = [(1000 + k, prose(5, 40), "en", "s", 0, "x", 1, "y", 0.5, 3, 1) for k in range(300)]
    docs = documents(spark, hot)
    found = exact.find(docs, keep=keep, cell_bytes=cell_bytes).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr) == plainly(rows, {"smallest": min, "largest": max}[keep])
    kept = [r for r in found if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_kept_rows_have_all_columns(spark):
    docs = documents(spark)
    found = exact.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect() if r["doc_id"] is not None) == [0, 2, 3, 5, 6, 7, 8, 9, 11]
    assert exact.find(empty(spark)).count() == 0 and exact.keep_one(empty(spark)).count() == 0


def test_normalised_texts(spark):
    docs = spark.createDataFrame([("b", "A  b"), ("a", "a b"), ("c", "a c")], "name string, body string")
    found = {r["name"]: r for r in exact.find(docs, "name", "body", lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))).collect()}
    assert (found["b"]["keep_id"], found["b"]["group_size"], found["c"]["group_size"]) == ("a", 2, 1)
