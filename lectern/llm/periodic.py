"""Periodic runs in texts by an enhanced suffix array.

A text's words are the stretches between ASCII white space. A run is a stretch of words with smallest period q, at least `times` * q and
`least` words long, that no neighbouring word extends with the same period. Texts are independent, so there is no shuffle: each
task takes its texts in blocks of about `BLOCK_WORDS` words.

For a block, the suffixes of all its texts are sorted together (by text first) by prefix doubling, in which only suffixes that are not told
apart yet are sorted again; the ranks of each round also give the longest common prefixes (LCP) of neighbours. The LCP
intervals are walked with a stack; there are no tree nodes. In an interval of depth d every suffix i outside the largest child is
tested: if the suffix i + d, or i - d, lies in the interval (by the inverse suffix array) but in another child, the words at i, or i - d, begin
a square of period d that ends where its run ends. Squares are rotated to the left to the beginning of their run; squares of a multiple of
the period of a run found before belong to that run.

A run of `times` periods repeats a passage one period shorter, so intervals without an LCP of max((`times` - 1) * d, `least` - d) or with
fewer than `times` suffixes hold no run and are left out; this drops no run.

Defined cases: a null or empty text has no words and no runs; ids are not used and may be null or repeated; rows that are repeated are
each described; a text is read whole however long it is (a text longer than a block is a block of its own; memory is some hundred bytes for each
of its words); of runs with equal exponents the one that starts first, then that with the smaller period, is the greatest; other columns
are kept, whatever their names (a clashing column gives way to the result's); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 300_000
TIMES, LEAST = 4, 6


def suffix_array(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order (of text, then words), their ranks, and the LCP of each with the one before it (0 for a text's first).
    doc and end: each word's text and the place after that text's last word."""
    n = len(codes)
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    first = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    while True:
        # places of groups of more than one suffix
        open_ = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(open_):
            break
        at = order[open_]
        ahead = at + step
        key = rank[at].astype(np.int64) * (n + 1) + np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, np.diff(key) != 0]
        first[open_] |= new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        levels.append(rank.copy())
        step *= 2
    before, after = order[:-1], order[1:]
    top = np.full(max(n - 1, 0), -1, np.int8)
    pairs = np.arange(n - 1)
    for t, level in enumerate(levels):  # the longest power of two that both begin with
        pairs = pairs[level[before[pairs]] == level[after[pairs]]]
        top[pairs] = t
    lcp = np.zeros(n, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        pairs = np.flatnonzero(top >= t)
        a, b = before[pairs] + lcp[pairs + 1], after[pairs] + lcp[pairs + 1]
        inside = (a < end[before[pairs]]) & (b < end[before[pairs]])
        equal = inside & (levels[t][np.minimum(a, n - 1)] == levels[t][np.minimum(b, n - 1)])
        lcp[pairs[equal] + 1] += 1 << t
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, lcp


def _small_children(lcp: np.ndarray, times: int, least: int) -> np.ndarray:
    """(depth, low, high, from, to): the children but the largest of every LCP interval [low, high] that can hold a run, by ranks."""
    n, out = len(lcp), []
    joined = np.r_[False, lcp[1:] >= 1]
    starts = np.flatnonzero(~joined)
    if not n:
        return np.empty((0, 5), np.int64)
    sizes = np.diff(np.r_[starts, n])
    shortest = min(max((times - 1) * d, least - d) for d in range(1, max(least, 2)))
    hold = (np.maximum.reduceat(lcp, starts) >= shortest) & (sizes >= times)
    for start, size in zip(starts[hold].tolist(), sizes[hold].tolist(), strict=True):
        depths = lcp[start : start + size].tolist()
        stack = [(0, start, 0, [])]  # depth, low, deepest inside, children
        for k in range(1, size + 1):
            low, depth, child = start + k - 1, depths[k] if k < size else 0, None
            while depth < stack[-1][0]:
                d, low, most, children = stack.pop()
                high = start + k - 1
                most = max(most, d)
                if high - low + 1 >= times and most >= max((times - 1) * d, least - d):
                    _split(out, d, low, high, children)
                child = (low, high, most)
                if depth <= stack[-1][0]:
                    _, under, deep, inside = stack[-1]
                    inside.append(child)
                    stack[-1] = (stack[-1][0], under, max(deep, most), inside)
                    child = None
            if depth > stack[-1][0]:
                stack.append((depth, low, child[2] if child else 0, [child] if child else []))
    return np.array(out, np.int64).reshape(-1, 5)


def _split(out: list, depth: int, low: int, high: int, children: list) -> None:
    largest = max(children, key=lambda c: c[1] - c[0], default=(low, low))
    at = low
    for a, b, *_ in children:
        for single in range(at, a):
            out.append((depth, low, high, single, single))
        if a != largest[0]:
            out.append((depth, low, high, a, b))
        at = b + 1
    for single in range(at, high + 1):
        if single != largest[0] or children:
            out.append((depth, low, high, single, single))


def squares(codes: np.ndarray, doc: np.ndarray, end: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(period, start) of the branching squares that can end a run of `times` (two or more) periods, in order."""
    order, inverse, lcp = suffix_array(codes, doc, end)
    found, children = [], _small_children(lcp, times, least)
    for at in range(0, len(children), 1 << 16):
        depth, low, high, a, b = children[at : at + (1 << 16)].T
        sizes = b - a + 1
        each = np.repeat(np.arange(len(a)), sizes)
        suffix = order[np.repeat(a - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
        for side in (1, -1):
            other = suffix + side * depth[each]
            ok = (other >= 0) & (other < len(codes))
            r = inverse[np.where(ok, other, 0)]
            ok &= (r >= low[each]) & (r <= high[each]) & ((r < a[each]) | (r > b[each]))
            found.append(np.stack([depth[each][ok], np.minimum(suffix, other)[ok]], 1))
    if not found:
        return np.empty((0, 2), np.int64)
    found = np.unique(np.concatenate(found), axis=0)
    q, i = found.T
    before = i - (times - 2) * q  # where the last `times` periods begin
    inside = (before >= 0) & (doc[np.maximum(before, 0)] == doc[i])
    inside &= codes[np.maximum(before, 0)] == codes[i]
    return found[inside]


def runs(codes: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(text, start in it, length, period) of every run, in order. begin and end: each word's text's first place and the place after its last."""
    out, known = [], defaultdict(list)
    for q, i in squares(codes, doc, end, times, least).tolist():
        stop, bottom = i + 2 * q, int(begin[i])
        if any(q % p == 0 and start <= i for start, p in known[stop]):
            continue
        # rotate to the left: how far do words equal those a period later
        start, stride = i, 64
        while start > bottom:
            low = max(bottom, start - stride)
            different = np.flatnonzero(codes[low:start] != codes[low + q : start + q])
            if len(different):
                start = low + int(different[-1]) + 1
                break
            start, stride = low, stride * 2
        known[stop].append((start, q))
        if stop - start >= max(least, times * q):
            out.append((int(doc[i]), start - bottom, stop - start, q))
    return sorted((d, s, n, p) for d, s, n, p in out)


def describe_block(texts: list[bytes]) -> Iterator[tuple]:
    """Of each text: n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    words = [t.split() for t in texts]  # bytes are split at ASCII white space only
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    found: dict[int, list] = defaultdict(list)
    if total:
        codes = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, total)
        doc = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        stops = np.cumsum(sizes)
        for d, *run in runs(codes, doc, np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)):
            found[d].append(run)
    for d, ws in enumerate(words):
        best, kept = (None, None, None), ws
        for start, length, period in found[d]:
            if best[0] is None or length * best[2] > best[1] * period or (length * best[2] == best[1] * period and (start, period) < (best[0], best[2])):
                best = (start, length, period)
        if found[d]:
            dropped = np.zeros(len(ws) + 1, np.int64)
            for start, length, period in found[d]:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = [ws[k] for k in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found[d], key=lambda r: (r[0], r[2])))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        yield len(ws), len(found[d]), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), kept


RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, text_col: str = "text", collapsed: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their text, and n_words, n_runs, the start, length, period and floor(1000 * exponent) of the run with the greatest exponent,
    runs_sha256 (of lines `start,length,period`) and collapsed_sha256 (of the text without the repeats of every run, its words joined by one space); with `collapsed`
    also that text. Defined cases: see the module's text."""
    added = RESULT + (", collapsed string" if collapsed else "")
    result = [part.split()[0] for part in added.split(", ")]
    carried = [c for c in docs.columns if c != text_col and c not in result]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), added])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            at = 0
            while at < len(texts):
                to, words = at, 0
                while to < len(texts) and (to == at or words + len(texts[to]) // 4 <= block_words):
                    words, to = words + len(texts[to]) // 4, to + 1
                rows = []
                for *row, kept in describe_block(texts[at:to]):
                    text = b" ".join(kept)
                    rows.append((*row, hashlib.sha256(text).hexdigest(), *([text.decode()] if collapsed else [])))
                kinds = [pa.int64()] * 6 + [pa.string()] * (len(result) - 6)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(at, to - at) for k in range(len(carried))), *columns], names=[*carried, *result])
                at = to

    return docs.select(F.col(f"`{text_col}`").cast("string"), *[F.col(f"`{c}`") for c in carried]).mapInArrow(blocks, schema)


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text with planted repeats: of every tenth id (by its checksum h), word a + k becomes word a + k % p of the text, with g = h // 10,
    a = g % n, p = 1 + (n - a) // (3 + g % 8); n is the number of words. Other texts stay as they are; so do those of null ids."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    split = F.when(F.pmod(h, F.lit(10)) == 0, words)
    changed = F.element_at(F.transform(F.array(split), lambda ws: F.when(F.size(ws) > 0, planted(ws))), 1)
    return F.coalesce(changed, text)
