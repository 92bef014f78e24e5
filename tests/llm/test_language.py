import re
from collections import Counter

import numpy as np
from conftest import SMALL
from fixtures import documents, empty

from lectern.llm import language
from lectern.llm.queries import op4_language
from lectern.session import table


def test_held_out_accuracy(spark):
    truth = table(spark, SMALL, "documents").select("doc_id", "lang")
    rows = op4_language(spark, SMALL).where("held_out").join(truth, "doc_id").collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_documents(spark):
    model = language.learn(documents(spark))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark), model).collect()}
    assert found[0] == found[1] == found[9] == "und" and found[3] == "en"
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.learn(empty(spark))
    assert {r["lang_pred"] for r in language.identify(documents(spark), nothing).collect()} == {"und"}


def test_rare_words_and_long_runs_count(spark):
    """A word or 5-gram far below any share of its language still decides, wherever its vector is looked up."""
    common = " ".join(["balimo"] * 150_000)
    rows = [("aa", common), ("bb", common), ("aa", "zelqu"), ("bb", "zelqo"), ("aa", "xabcdx xbcdey"), ("bb", "xabcdy xbcdex")]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    known = {(r["lang"], r["item"]) for r in model.where("size = 0").collect()}
    assert {("aa", "zelqu"), ("bb", "zelqo")} <= known
    assert {r["size"] for r in model.select("size").distinct().collect()} == {0, 1, 2, 3, 4, 5}
    docs = spark.createDataFrame([(1, "zelqu"), (2, "zelqo"), (3, "qabcdx"), (4, "qabcdy"), (5, "balimo zelqo zelqo"), (5, "balimo zelqo zelqo")], "doc_id long, text string")
    found = sorted(tuple(r) for r in language.identify(docs, model).collect())
    assert [f[1] for f in found] == ["aa", "bb", "aa", "bb", "bb", "bb"]
    everything = sorted(tuple(r) for r in language.identify(docs, model, sent_share=0.0).collect())
    nothing = sorted(tuple(r) for r in language.identify(docs, model, sent_share=2.0).collect())
    for a, b, c in zip(found, everything, nothing):
        assert a[:2] == b[:2] == c[:2] and abs(a[2] - b[2]) < 1e-5 and abs(a[2] - c[2]) < 1e-5


def test_ties_long_texts_and_the_model_by_brute_force(spark):
    """Equal languages: the first by name. A text longer than a block scores as its parts do. Counts against plain dictionaries."""
    rows = [(lang, text) for lang in ("bb", "aa") for text in ("Kemo, tu-ran 12 kemo", "sel_ba")] + [("cc", "zu zu"), (None, "kemo"), ("aa", None)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    found = {(r["lang"], r["size"], r["item"]): r["n"] for r in model.collect()}
    expected = Counter()
    for lang, text in rows:
        for word in re.findall(r"[^\W\d_]+", text.lower()) if lang and text else []:
            expected[lang, 0, word] += 1
            for size in language.LENGTHS:
                expected.update((lang, size, f"^{word}$"[k : k + size]) for k in range(len(word) + 3 - size))
    assert found == expected
    long = " ".join(["kemo"] * 900_000)
    docs = spark.createDataFrame([(1, "kemo", 1.0, "x"), (2, long, 2.0, "y"), (3, "zu", 3.0, "z"), (4, "12 _", 4.0, "und")], "doc_id long, text string, score double, lang_pred string")
    assert [(r["doc_id"], r["lang_pred"]) for r in language.identify(docs, model).orderBy("doc_id").collect()] == [(1, "aa"), (2, "aa"), (3, "cc"), (4, "und")]
    small = language.Summer(["kemo"], np.array([[1.0, 2.0]]))
    sums, words, counts = small.split([long, None, "kemo other Kemo OTHER", ""])
    assert sums.to_pylist() == [[900_000.0, 1_800_000.0], None, [2.0, 4.0], None]
    assert words.to_pylist() == [[], [], ["other"], []] and counts.to_pylist() == [[], [], [2], []]
