"""The figures for which two operators leave a part of their method: README quotes them."""

import hashlib

import pytest
from conftest import SMALL

from lectern.llm import jaccard, linededup

TABLE = SMALL.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize(("depth", "met"), [(8, 0.947), (7, 0.977), (6, 0.992), (5, 0.9983), (4, 0.99978)])
def test_chance_to_meet_at_a_prefix_depth(depth, met):
    """A pair at 0.8 over 16 trees: deeper prefixes than 4 miss the target of the join."""
    chance = 1 - (1 - 0.8**depth) ** jaccard.TREES
    assert chance == pytest.approx(met, abs=6e-4) and (chance >= jaccard.RECALL) == (depth <= jaccard.depth_for(0.8, jaccard.TREES, jaccard.DEPTH, jaccard.RECALL))


def chunked(texts, lines_of_hash, one_in):
    """Lines that content-defined chunks find: a chunk ends where a rolling hash over its last lines says so; chunks that stand elsewhere before are extended line by
    line as far as both places agree."""
    first, marked = {}, {}
    digest = lambda *parts: int.from_bytes(hashlib.sha256("\n".join(parts).encode()).digest()[:8], "big")
    for doc, lines in texts.items():
        begin = 0
        for k in range(len(lines)):
            if digest(*lines[max(0, k + 1 - lines_of_hash) : k + 1]) % one_in == 0 or k + 1 == len(lines):
                place = first.setdefault("\n".join(lines[begin : k + 1]), (doc, begin))
                if place != (doc, begin):
                    other, (a, b) = texts[place[0]], (begin, k + 1)
                    shift = place[1] - begin
                    while a > 0 and a + shift > 0 and lines[a - 1] == other[a + shift - 1]:
                        a -= 1
                    while b < len(lines) and b + shift < len(other) and lines[b] == other[b + shift]:
                        b += 1
                    marked.setdefault(doc, set()).update(range(a, b))
                begin = k + 1
    return marked


def test_share_of_lines_that_chunks_find(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = {r["doc_id"]: r["text"].split("\n") for r in docs.collect() if r["text"]}
    found = linededup.remove_repeats(docs).where("__removed > 0").select("doc_id", "text", "__removed").collect()
    wanted = {}
    for r in found:  # which lines are gone: the kept ones are a subsequence
        kept, lines, at = r["text"].split("\n") if r["text"] else [], texts[r["doc_id"]], 0
        for k, line in enumerate(lines):
            if at < len(kept) and kept[at] == line and len(lines) - k > 0 and len(kept) - at <= len(lines) - k:
                at += 1
            else:
                wanted.setdefault(r["doc_id"], set()).add(k)
    total = sum(map(len, wanted.values()))
    assert total == sum(r["__removed"] for r in found)
    shares = {}
    for lines_of_hash in (1, 2):
        for one_in in (2, 4, 8):
            marked = chunked(texts, lines_of_hash, one_in)
            shares[lines_of_hash, one_in] = sum(len(own & marked.get(doc, set())) for doc, own in wanted.items()) / total
    print(shares)
    assert all(0.6 < share < 0.9 for share in shares.values())
