import numpy as np
from conftest import MIDDLE, SMALL
from fixtures import documents, empty, prose

from lectern.llm import toxicity
from lectern.llm.queries import op8_toxicity, training_labels
from lectern.session import table


def test_held_out_rows(spark):
    """On the larger table, whose labels show every language's marks: only rows that were not learned from count."""
    truth = table(spark, MIDDLE, "labels").select("doc_id", "toxic")
    rows = op8_toxicity(spark, MIDDLE).where("held_out").join(truth, "doc_id").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(clean) <= 0.02 * len(clean) and len(toxic) >= 100 and sum(toxic) >= 0.85 * len(toxic)
    assert all((r["score"] >= 0.3) == r["predicted"] for r in rows)


def test_stage_keeps_what_the_query_does_not_mark(spark):
    docs = table(spark, SMALL, "documents")
    marked = {r["doc_id"] for r in op8_toxicity(spark, SMALL).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, training_labels(table(spark, SMALL, "labels"))).collect()}
    assert marked and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - marked


def test_learned_words(spark):
    rows = [(k, prose(k, 40) + (" zorgu zorgum" if k % 4 == 0 else ""), None, None, 0, "", 0, "", 0.0, 0, 0) for k in range(100, 300)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(100, 260)], "doc_id long, toxic int, quality int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert all((found[k] >= 0.3) == (k % 4 == 0) for k in range(260, 300))


def test_awkward_documents(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (7, None), (8, 0), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        found = toxicity.score(documents(spark), known).collect()
        assert len(found) == documents(spark).count() and all(0 <= r["score"] <= 1 for r in found)
        assert toxicity.keep_clean(documents(spark), known).columns == documents(spark).columns
    assert toxicity.score(empty(spark), labels).count() == 0


def test_label_model_finds_correlated_voters():
    draw = np.random.default_rng(1)
    patterns = []
    for _ in range(3000):
        y = draw.random() < 0.2
        votes = [2 if draw.random() < (0.7 if y else 0.05) else 0 for _ in range(toxicity.VOTERS)]
        votes[1] = votes[0]
        code = 0
        for v in reversed(votes):
            code = code * 3 + v
        patterns.append((code, None, 1.0))
    model = toxicity.LabelModel(patterns)
    assert abs(model.share - 0.2) < 0.05
    assert any({0, 1} <= set(c) for c in model.cliques)


def test_lexicon_counts_texts_that_share_a_passage(spark):
    """Only near copies count once, and their label is that of the kept row."""
    passage = prose(1, 100)
    rows = [(k, f"{passage} {prose(k, 60)}" + (" zorgu" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(100, 160)]
    rows += [(k, f"{prose(7, 90)} blixor {prose(8, 90)} end{k}", 1) for k in range(200, 220)]
    found = {(kind, item) for kind, item, _ in toxicity.learn_lexicon(spark.createDataFrame(rows, "__id long, text string, label int"))}
    assert ("word", "zorgu") in found and ("word", "blixor") not in found


def test_held_out_rows_of_the_small_table(spark):
    """Of 14 toxic held-out rows at sf0.01 nine are caught (languages other than English have ten toxic rows to learn from), and no clean one is marked."""
    folder = "/root/testdata/sf0.01"
    truth = table(spark, folder, "labels").select("doc_id", "toxic")
    rows = op8_toxicity(spark, folder).where("held_out").join(truth, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert len(toxic) == 14 and sum(toxic) >= 9 and not any(r["predicted"] for r in rows if r["toxic"] == 0)


def patterns_of(seed, count):
    """Votes drawn for a hidden class, some of them with the class known."""
    draw, found = np.random.default_rng(seed), []
    for _ in range(count):
        y = int(draw.random() < 0.3)
        votes = [int(draw.choice([0, 1, 2], p=[0.4, 0.2, 0.4] if y else [0.5, 0.45, 0.05])) for _ in range(toxicity.VOTERS)]
        votes[2] = votes[1] if draw.random() < 0.9 else votes[2]
        code = sum(v * 3**k for k, v in enumerate(votes))
        found.append((code, y if draw.random() < 0.2 else None, float(draw.integers(1, 4))))
    return found


def test_posterior_against_plain_sums():
    """One more round of expectation-maximisation, by loops over the patterns, changes nothing; posteriors are Bayes' rule over the cliques."""
    patterns = patterns_of(2, 400)
    model = toxicity.LabelModel(patterns)
    total = sum(n for _, _, n in patterns)
    share = min(max(sum(n * q for (_, _, n), q in zip(patterns, model.posterior)) / total, 1e-3), 1 - 1e-3)
    chance = []
    for clique in model.cliques:
        sums = {}
        for (code, _, n), q in zip(patterns, model.posterior):
            joint = tuple(toxicity.votes_of(code)[k] for k in clique)
            for y, part in ((1, q), (0, 1 - q)):
                sums[y, joint] = sums.get((y, joint), 0.1) + n * part
        # every joint vote that never came counts a tenth as well
        whole = {y: sum(v for (own, _), v in sums.items() if own == y) + 0.1 * (3 ** len(clique) - len({j for _, j in sums})) for y in (0, 1)}
        chance.append(lambda y, joint, sums=sums, whole=whole: sums.get((y, joint), 0.1) / whole[y])
    for (code, known, _), q in list(zip(patterns, model.posterior))[:60]:
        votes, odds = toxicity.votes_of(code), share / (1 - share)
        for clique, of in zip(model.cliques, chance):
            joint = tuple(votes[k] for k in clique)
            odds *= of(1, joint) / of(0, joint)
        assert abs(q - (known if known is not None else odds / (1 + odds))) < 1e-3


def test_classifier_against_plain_descent():
    """Newton's weights are where a plain gradient vanishes, and plain gradient descent comes to the same."""
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(200, 3)), draw.random(200)
    beta = toxicity.logistic(x, y, 1e-2)
    weights, bias = np.zeros(3), 0.0
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ weights + bias)))
        weights, bias = weights - 0.01 * (x.T @ (p - y) + 2.0 * weights), bias - 0.01 * float((p - y).sum())
    assert np.abs(beta - np.array([*weights, bias])).max() < 1e-4


def test_cliques_are_bounded_and_hold_correlated_voters():
    model = toxicity.LabelModel(patterns_of(3, 600))
    assert max(map(len, model.cliques)) <= toxicity.CLIQUE and any({1, 2} <= set(c) for c in model.cliques)
