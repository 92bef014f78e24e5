import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from fixtures import documents, empty, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import periodic
from lectern.llm.queries import op12_runs


def plain_runs(words):
    """All runs by the definition: for every period, maximal stretches whose words equal those a period before; the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = q
        while at < n:
            if words[at] != words[at - q]:
                at += 1
                continue
            start = at - q
            while at < n and words[at] == words[at - q]:
                at += 1
            if at - start >= max(6, 4 * q):
                found.setdefault((start, at - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(text, doc_id=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    from fractions import Fraction

    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(kept)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def of_block(texts):
    out = []
    for _, *row, kept in periodic.describe_block([t.encode() for t in texts]):
        out.append((*row, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=4), min_size=1, max_size=4))
def test_block_equals_brute_force(docs):
    texts = [" ".join(w for unit, times in parts for w in unit * times) for parts in docs]
    assert of_block(texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "abcd", "abcdefghijklmnop"])
def test_random_words(letters):
    draw = random.Random(len(letters))
    texts = [" ".join(draw.choice(letters) for _ in range(draw.randint(0, 150))) for _ in range(60)]
    assert of_block(texts) == [plain(t) for t in texts]


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(30):
        docs = [[draw.randint(0, 2) for _ in range(draw.randint(1, 30))] for _ in range(3)]
        sizes = np.array([len(d) for d in docs])
        doc, stops = np.repeat(np.arange(3), sizes), np.cumsum(sizes)
        order, inverse, lcp = periodic.suffix_array(np.array(sum(docs, [])), doc, np.repeat(stops, sizes))
        starts = stops - sizes
        suffixes = [(d, docs[d][k:]) for d in range(3) for k in range(len(docs[d]))]
        assert [suffixes[i] for i in order] == sorted(suffixes) and (order[inverse] == np.arange(len(order))).all()
        for k in range(1, len(order)):
            (d, x), (e, y) = suffixes[order[k - 1]], suffixes[order[k]]
            assert lcp[k] == (0 if d != e else next((m for m, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y))))
        assert starts[0] == 0


def test_long_repeats_are_quick():
    words = ["w"] * 20_000
    assert periodic.describe_block([" ".join(words).encode()]).__next__()[:6] == (20_000, 1, 0, 20_000, 1, 20_000_000)
    unit = prose(4, 3000).split()
    (row,) = list(periodic.describe_block([" ".join(["x", *unit * 5, "y"]).encode()]))
    assert row[1:6] == (1, 1, 15_000, 3000, 5000)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_runs(spark, SMALL).collect()}
    assert found == {r["doc_id"]: plain(r["text"], r["doc_id"]) for r in docs}
    assert any(v[0] for v in found.values())


def test_awkward_documents(spark):
    odd = "a b\x1c c\x0b" * 9
    docs = documents(spark, [(20, odd, "en", "s", 0, "x", 1, "y", 0.5, 3, 1), (21, "go " * 7 + "\n stop", None, None, None, None, None, None, None, None, None)])
    found = periodic.find_runs(docs, collapsed=True, block_words=50)
    assert [c for c in docs.columns if c not in ("text", "length")] == [c for c in found.columns if c in docs.columns and c != "length"]
    rows = {r["doc_id"]: r for r in found.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in rows.items()} == {i: plain(t) for i, t in texts.items()}
    assert rows[21]["collapsed"] == "go stop" and rows[0]["n_words"] == 0 and rows[0]["collapsed"] == ""
    assert found.count() == docs.count() and periodic.find_runs(empty(spark)).count() == 0
