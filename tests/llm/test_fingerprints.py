import hashlib

import oracle
from conftest import SMALL
from fixtures import documents, empty, prose

from lectern.llm import imatch
from lectern.llm.queries import OP3_SQL, op3_imatch
from lectern.session import table


def check(rows, docs):
    """docs: (id, text) in descending order of ids."""
    follows = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 3
        follows.setdefault(i, set()).add((len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    for r in rows:
        assert (r["n_chars"], r["edited_sha256"]) in follows[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_whole_table(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, SMALL, "documents").collect()), reverse=True)
    rows = op3_imatch(spark, SMALL).collect()
    check(rows, docs)
    prints = {}
    for r in rows:
        prints.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.9 * len(rows)


def test_query_agrees_with_sql(spark):
    oracle.check(op3_imatch(spark, SMALL), OP3_SQL, SMALL)


def test_awkward_documents(spark):
    frame = documents(spark)
    rows = imatch.compare_edited(frame).collect()
    assert len(rows) == frame.count()
    one = {r["doc_id"]: r for r in rows}
    assert one[2]["fingerprint"] == one[10]["fingerprint"] and one[0]["fingerprint"] == one[1]["fingerprint"] == one[9]["fingerprint"]
    assert imatch.compare_edited(empty(spark)).count() == 0
    assert imatch.compare_edited(frame.where("doc_id = 6")).first()["near_next"] == 1.0


def test_ranges_of_ids(spark):
    frame = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), reverse=True)
    check(imatch.compare_edited(frame, range_rows=3).collect(), docs)


def test_outlying_and_textual_ids(spark):
    frame = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    far = frame.selectExpr("CASE doc_id WHEN 3 THEN 9000000000000 WHEN 4 THEN -7 ELSE doc_id END AS doc_id", "text")
    check(imatch.compare_edited(far, range_rows=3).collect(), sorted(((r["doc_id"], r["text"] or "") for r in far.collect()), reverse=True))
    named = frame.selectExpr("concat('d', char(97 + doc_id)) AS doc_id", "text")
    check(imatch.compare_edited(named, range_rows=3).collect(), sorted(((r["doc_id"], r["text"] or "") for r in named.collect()), reverse=True))


def test_one_term_changes_a_long_text(spark):
    """No term of the band is left out, however long the text; nearly equal texts keep most hashes of the sparse subsets."""
    long = prose(6, 6000).split()
    base = [(k, " ".join(long)) for k in range(3)] + [(k, prose(k, 200)) for k in range(10, 30)]
    edited = [(100 + k, " ".join([*long[: 140 * k], "kemotusel" * 3, *long[140 * k + 1 :]])) for k in range(40)]
    docs = spark.createDataFrame(base + edited, "doc_id long, text string")
    rows = imatch.fingerprint(docs, "text", "print", imatch.lexicon(docs, "text", 0.0, 1.0))
    found = {r["doc_id"]: r["print"] for r in rows.select("doc_id", "print").collect()}
    assert found[0] == found[1] == found[2]
    for k in range(40):
        other = found[100 + k]
        active = [(x, y) for x, y in zip(found[0], other) if (x, y) != (imatch.EMPTY, imatch.EMPTY)]
        assert found[0] != other and sum(x == y for x, y in active) > 0.5 * len(active)
    assert sum(x == y != imatch.EMPTY for x, y in zip(found[0], found[10])) < 0.5 * len(found[0])
