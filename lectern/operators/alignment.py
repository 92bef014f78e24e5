"""Alignment of body units with runs of chunks.

A row holds the texts of a document's chunks and units. Their tokens, near pairs and runs are worked out for all rows of an Arrow batch at once, on numbers
and in blocks of bounded size; only the greedy choice goes unit by unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST, SHARE, ENOUGH, LEAST = 8, 0.45, 0.80, 0.45
#: Chunks and units that are worked out at once, unless one document has more, and rows of one block of looked-up or compared tokens, unless one unit or chunk
#: has more: what fits a core's cache.
STRETCH, BLOCK = 4_000, 100_000
#: The bytes of tokens.
LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of the items whose weights come to `most` at most, or of one item."""
    ends, low = np.cumsum(weights), 0
    while low < len(weights):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers in order, each once. Most occur once, where sorting is several times as fast as the hashing of np.unique."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) != 0]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text and the letters of each token of texts in lower case: what text.alignment_tokens finds, repetitions included."""
    texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = LETTERS[data]
    opens, bounds = letter.copy(), ends[ends < len(data)]
    opens[1:] &= ~letter[:-1]
    opens[bounds] = letter[bounds]
    begins = np.flatnonzero(opens)
    places = np.append(np.cumsum(letter)[begins] - 1, letter.sum()).astype(np.int32)
    return np.searchsorted(ends, begins, side="right") - 1, pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(data[letter]))


class _Tokens:
    """The chunks and units of a batch of documents, with a number for each distinct token of a document; in a chunk or unit a token counts once."""

    def __init__(self, chunks: pa.Array, units: pa.Array):
        document = [np.repeat(np.arange(len(lists)), _sizes(lists)) for lists in (chunks, units)]
        self.at = _ramp(_sizes(chunks))
        (holder, words), (asker, asked) = _words(chunks.flatten()), _words(units.flatten())
        named = pa.concat_arrays([words, asked]).dictionary_encode()
        of = np.concatenate([document[0][holder], document[1][asker]])
        kinds, numbers = np.unique(of * max(len(named.dictionary), 1) + named.indices.to_numpy(), return_inverse=True)
        self.kinds = max(len(kinds), 1)
        self.chunk, self.token = np.divmod(_distinct(holder * self.kinds + numbers[: len(holder)]), self.kinds)
        self.known = _distinct(asker * self.kinds + numbers[len(holder) :])
        self.unit, self.word = np.divmod(self.known, self.kinds)
        self.m, self.n = np.bincount(self.chunk, minlength=len(document[0])), np.bincount(self.unit, minlength=len(document[1]))
        self.first = np.cumsum(self.m) - self.m
        self.token_at = np.cumsum(self.m > 0)
        self.order = np.argsort(self.token, kind="stable")


def _pairs(t: _Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units and chunks, by unit and chunk, that share one of the chunk's rarest tokens: of m tokens of which h = ceil(SHARE * m) have to be shared any m - h + 1."""
    frequent = np.bincount(t.token, minlength=t.kinds)[t.token]
    rank = np.empty(len(t.token), np.int64)
    rank[np.lexsort((frequent, t.chunk))] = np.arange(len(t.token)) - t.first[t.chunk]
    asked = rank <= (t.m - np.ceil(t.m * SHARE - 1e-9))[t.chunk]
    probes = t.order[asked[t.order]]
    held = np.bincount(t.token[probes], minlength=t.kinds)
    begin, hits = (np.cumsum(held) - held)[t.word], held[t.word]
    ends = np.concatenate([[0], np.cumsum(t.n)])
    for low, high in _blocks(np.diff(np.concatenate([[0], np.cumsum(hits)])[ends]), BLOCK):
        own = slice(ends[low], ends[high])
        found = t.chunk[probes[np.repeat(begin[own], hits[own]) + _ramp(hits[own])]]
        yield np.divmod(_distinct(np.repeat(t.unit[own], hits[own]) * len(t.m) + found), max(len(t.m), 1))


def _near(t: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units and the chunks that have SHARE of their tokens in them, and for each pair how many of the shared tokens none of the 0, 1, ... chunks before has.

    Only chunks with tokens count. A token's last place before does not depend on the unit, so that the tokens a run covers are a sum over its chunks.
    """
    gap, again = np.full(len(t.token), LONGEST), np.diff(t.token[t.order]) == 0
    gap[t.order[1:][again]] = np.minimum(np.diff(t.token_at[t.chunk[t.order]])[again], LONGEST)
    out = [(np.empty(0, np.int64),) * 2 + (np.empty((0, LONGEST), np.int64),)]
    for units, chunks in _pairs(t):
        for low, high in _blocks(t.m[chunks], BLOCK):
            u, c = units[low:high], chunks[low:high]
            pair = np.repeat(np.arange(len(u)), t.m[c])
            at = np.repeat(t.first[c], t.m[c]) + _ramp(t.m[c])
            asked = u[pair] * t.kinds + t.token[at]
            shared = t.known[np.minimum(np.searchsorted(t.known, asked), len(t.known) - 1)] == asked
            counts = np.bincount(pair[shared] * LONGEST + gap[at[shared]] - 1, minlength=len(u) * LONGEST).reshape(-1, LONGEST)
            fresh = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
            near = fresh[:, 0] / t.m[c] >= SHARE
            out.append((u[near], c[near], fresh[near]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


class _Runs:
    """The candidate runs of a batch of documents by unit and start, see runs(): unit, begin and last (chunks as counted in the document), start, coverage, size, values (reading orders)."""

    def __init__(self, orders: pa.Array, chunks: pa.Array, units: pa.Array):
        t, reading = _Tokens(chunks, units), orders.flatten().to_numpy(zero_copy_only=False)
        unit, chunk, fresh = _near(t)
        at, token_at = t.at[chunk], t.token_at[chunk]
        # starts whose first near chunk this is: how many chunks they lie before it
        before = np.full(len(at), -1)
        before[1:] = np.where(np.diff(unit) == 0, at[:-1], -1)
        starts = np.minimum(at - before, LONGEST)
        first = np.repeat(np.arange(len(unit)), starts)
        self.unit, self.begin = unit[first], at[first] - starts[first] + 1 + _ramp(starts)
        self.size, covered, tokens, rows = np.ones(len(first), np.int64), fresh[first, 0], t.n[self.unit], np.arange(len(first))
        for k in range(1, LONGEST):
            rows = rows[(covered[rows] / tokens[rows] < ENOUGH) & (first[rows] + k < len(unit))]
            now = first[rows] + k
            on = (unit[now] == self.unit[rows]) & (token_at[now] - token_at[first[rows]] == k) & (at[now] < self.begin[rows] + LONGEST)
            rows, now = rows[on], now[on]
            self.size[rows] += 1
            covered[rows] += fresh[now, k]
        self.coverage, self.per_unit = covered / tokens, np.bincount(self.unit, minlength=len(t.n))
        self.last = at[first + self.size - 1]
        self.start = reading[chunk[first] - at[first] + self.begin]
        self._taken, self._first = reading[chunk], first

    def taken(self, rows: np.ndarray) -> pa.Array:
        """The reading orders of the chunks of runs, as lists."""
        values = self._taken[np.repeat(self._first[rows], self.size[rows]) + _ramp(self.size[rows])]
        return _listed(self.size[rows], pa.array(values, pa.int32()))


def _structs(kind: T.StructType, *fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(fields, kind.names)


INTEGERS = T.ArrayType(T.IntegerType())
RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("chunks", INTEGERS), T.StructField("coverage", T.DoubleType())])
CHOICE = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("chunks", INTEGERS)])


def _every(orders: pa.Array, chunks: pa.Array, units: pa.Array) -> pa.Array:
    """The runs of each unit of each document."""
    r = _Runs(orders, chunks, units)
    every = _structs(RUN, pa.array(r.start, pa.int32()), r.taken(np.arange(len(r.start))), pa.array(r.coverage, pa.float64()))
    return _listed(_sizes(units), _listed(r.per_unit, every))


def _chosen(orders: pa.Array, chunks: pa.Array, units: pa.Array) -> pa.Array:
    """The run of each unit of each document that has one, see align()."""
    r, per_document = _Runs(orders, chunks, units), _sizes(units)
    document, number = np.repeat(np.arange(len(units)), per_document), _ramp(per_document)
    ends, rows, cursor, current = np.cumsum(r.per_unit), [], -1, -1
    for unit in np.flatnonzero(r.per_unit).tolist():
        if document[unit] != current:
            cursor, current = -1, document[unit]
        low, high = ends[unit] - r.per_unit[unit], ends[unit]
        low += np.searchsorted(r.begin[low:high], cursor, side="right")
        if low < high:
            own = r.coverage[low:high]
            best = (own >= ENOUGH).argmax()
            best = best if own[best] >= ENOUGH else own.argmax()
            if own[best] >= LEAST:
                rows.append(low + best)
                cursor = r.last[rows[-1]]
    rows = np.array(rows, np.int64)
    found = _structs(CHOICE, pa.array(number[r.unit[rows]], pa.int32()), pa.array(r.start[rows], pa.int32()), r.taken(rows))
    return _listed(np.bincount(document[r.unit[rows]], minlength=len(units)), found)


def _stretches(work: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """The work on lists of documents, done for some documents after the others."""

    def run(orders: pa.Array, chunks: pa.Array, units: pa.Array) -> pa.Array:
        parts = [work(*(lists[low:high] for lists in (orders, chunks, units))) for low, high in _blocks(_sizes(chunks) + _sizes(units), STRETCH)]
        return pa.concat_arrays(parts or [work(orders, chunks, units)])

    return run


def _documents(units: DataFrame, chunks: DataFrame, found: Callable[..., pa.Array], kind: T.DataType) -> DataFrame:
    """One row for each document: document_id, numbers (of its units) and found. All is keyed by document, so tables dealt by it are not dealt anew."""
    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    listed = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col("reading_order").cast("int").alias("reading_order"), text))).alias("cs"))
    asked = units.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", text))).alias("us"))
    rows = asked.join(listed.hint("merge"), "document_id")
    once = F.arrow_udf(_stretches(found), T.ArrayType(kind)).asNondeterministic()  # else filters that Spark adds before explode work it out again
    return rows.select("document_id", F.col("us.unit_no").alias("numbers"), once("cs.reading_order", "cs.text", "us.text").alias("found"))


def runs(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidate runs from every start that has one: document_id, unit_no, start, chunks (their reading orders), coverage.

    A start looks at LONGEST consecutive chunks. Those without tokens are passed over, and so are those before the first near one; the first after it
    that is not near ends the run, and so does the one with which the unit's tokens are covered to ENOUGH. A start before its first near
    chunk sees less behind it, so every start is a candidate of its own: there are at most LONGEST for each near pair. Tokens are compared as such,
    not by digests.
    """
    rows = _documents(units, chunks, _every, T.ArrayType(RUN)).select("document_id", F.explode(F.arrays_zip("numbers", "found")).alias("u"))
    return rows.select("document_id", F.col("u.numbers").alias("unit_no"), F.inline("u.found"))


def align(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """The run chosen for each unit: document_id, unit_no, start, chunks.

    Units go in order, and a match moves the cursor past its last chunk: the first start after the cursor that covers ENOUGH, else the
    first of those that cover most, if that is LEAST.
    """
    rows = _documents(units, chunks, _chosen, CHOICE).select("document_id", "numbers", F.explode("found").alias("m"))
    return rows.select("document_id", F.get("numbers", "m.unit").cast("int").alias("unit_no"), "m.start", "m.chunks")


def selected_chunks(aligned: DataFrame) -> DataFrame:
    """The chunks of all chosen runs: document_id, reading_order. A chunk is in one run at most."""
    return aligned.select("document_id", F.explode("chunks").alias("reading_order"))
