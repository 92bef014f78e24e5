from collections import Counter

from conftest import SMALL
from fixtures import documents, empty, prose
from oracle import check

from lectern.llm import jaccard
from lectern.llm.queries import OP2_SQL, op2_jaccard
from lectern.llm.words import words
from lectern.session import table


def brute(rows):
    """(class, links) of each row by comparing all pairs of word shingle sets."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("text", text or "")]))
    links, root = Counter(), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows))


def test_whole_table_and_awkward_documents(spark):
    for docs in (table(spark, SMALL, "documents"), documents(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert Counter(tuple(r) for r in jaccard.join(docs).collect()) == brute(rows)


def test_query_agrees_with_sql(spark):
    check(op2_jaccard(spark, SMALL), OP2_SQL, SMALL)


def test_blocks_of_a_large_group_lose_no_link(spark):
    base = prose(5, 200).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[k * 3] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.join(docs, block=7).collect()) == brute(rows)


def test_one_of_each_group_stays(spark):
    kept = jaccard.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[3] == 1 and 4 not in ids and 5 not in ids and ids[2] == 1 and 10 not in ids and ids[None] == 1
    assert jaccard.join(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0


def test_depth_reaches_the_recall():
    depth = jaccard.depth_for(0.8, 16, 8, 0.9995)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.9995 > 1 - (1 - 0.8 ** (depth + 1)) ** 16


def test_a_null_id_is_not_an_empty_one(spark):
    docs = spark.createDataFrame([(None, prose(1, 40)), ("", prose(2, 40)), ("b", prose(2, 40)), (None, prose(2, 40))], "doc_id string, text string")
    kept = {(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()}
    assert kept == {(None, prose(1, 40)), (None, prose(2, 40))}
