import struct
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from fixtures import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing
from lectern.llm.queries import tokenizer
from lectern.session import table

PATH = tokenizer("byte_bpe_50k.json")


def check(frame, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in frame.collect():
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, texts in docs.items():
        expected = Counter()
        for text in texts:
            ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
            for n, (start, length) in enumerate(packing.cut(len(ids), 2048)):
                part = ids[start : start + length]
                expected[n, start, length, zlib.crc32(struct.pack(f"<{length}I", *part))] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == expected
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for spans in fill.values() for _, n in spans)
    return len(fill), -(-total // 2048)


def test_awkward_documents(spark):
    docs = defaultdict(list)
    for r in documents(spark).collect():
        docs[r["doc_id"]].append(r["text"])
    check(packing.pack(documents(spark), PATH), docs)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_whole_table(spark):
    rows = table(spark, SMALL, "documents")
    docs = {r["doc_id"]: [r["text"]] for r in rows.collect()}
    used, least = check(packing.pack(rows, PATH), docs)
    assert used <= least * 1.02 + 1


@pytest.mark.parametrize("text", ["a  b", " a", "a \n b", "A\n\nB", "it's\t'tis", "<|endoftext|>x", "x² y", "日本 a", "\n\na", "a ", "'s a", "It's we'll 12a_b __c", "\r\na", "a½ b", "a\u200bb", "\u0130x"])
def test_ids_equal_the_tokenizers(text):
    own = packing.word_ids(PATH)
    ids = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used, bins = Counter(), 0
    for lengths, times in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        bins += times
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    # best-fit decreasing stays within 11/9 of the optimum plus one
    assert bins <= max(1, -(-sum(n * c for n, c in counts.items()) // 64)) * 1.5 + 2 or all(n > 32 for n in counts)
