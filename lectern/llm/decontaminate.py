"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into partitions by their number of shingles (up to m, m a power of two). A document is read in overlapping windows of
2 m shingles, one series for each partition, so that however long it is, an item of that partition meets a domain of its own size:
a passage that contains it lies within one window, whose Jaccard similarity to it has a known lower bound. From that bound comes
the number of min-wise hash functions with which a window and the item agree in at least one minimum with the target probability.
Window minima are built from minima of short segments, so one pass over a text's shingles serves all partitions. Items that
agree with a window are verified on the whole text: the share of the item's distinct shingles that the text has.

Items of up to half the least partition's size, of which all shingles must be there, are looked up by one of their shingles instead.

The test items are sent to the tasks in blocks of bounded size, each block one pass over the documents; documents are never
shuffled.

Defined cases: an item or text that is null or has fewer than five words has no shingle here and is never matched; repeated items or
documents give a row each; a text is read whole however long it is; an empty table on either side gives no pairs and keeps all
documents; other columns are ignored by `find` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.words import SHINGLE, distinct, minima, multipliers, shingle_sequence, word_hashes

THRESHOLD = 0.8
RECALL = 0.999999
LEAST_SIZE = 8
#: Characters of test items in one block.
BLOCK_CHARS = 16_000_000
SEED = 20240217
_BITS = 20


def functions_for(threshold: float, recall: float) -> int:
    """Hash functions needed for an item of m / 2 shingles, the smallest of its partition, and a window of 2 m."""
    share = threshold / 2
    bound = share / (2 + 0.5 - share)
    return math.ceil(math.log(1 - recall) / math.log(1 - bound))


def shingles(text: str | None) -> np.ndarray:
    hashed = word_hashes(text)
    return shingle_sequence(hashed) if len(hashed) >= SHINGLE else hashed[:0]


class Index:
    """The minima of a block of items, by partition and hash function."""

    def __init__(self, items: list[tuple], threshold: float, recall: float):
        self.threshold = threshold
        self.factors = multipliers(functions_for(threshold, recall), SEED)
        self.items = [(item, distinct(shingles(text))) for item, text in items]
        self.partitions: dict[int, tuple[np.ndarray, dict[tuple[int, int], list[int]]]] = {}
        self.short: dict[int, list[int]] = {}
        for k, (_, own) in enumerate(self.items):
            if not len(own):
                continue
            if len(own) <= LEAST_SIZE // 2 and len(own) - 1 < threshold * len(own) - 1e-9:
                self.short.setdefault(int(own[0]), []).append(k)
                continue
            size = max(LEAST_SIZE, 1 << (len(own) - 1).bit_length())
            seen, found = self.partitions.setdefault(size, (np.zeros(1 << _BITS, bool), {}))
            lows = minima(own, self.factors)
            seen[self._slots(lows)] = True
            for function, low in enumerate(lows.tolist()):
                found.setdefault((function, low), []).append(k)
        self.unit = min(self.partitions, default=LEAST_SIZE)
        self.short_keys = np.array(sorted(self.short), np.uint64)

    def _slots(self, lows: np.ndarray) -> np.ndarray:
        """Places in the partition's bitmap, of values whose last axis runs over the hash functions."""
        return ((lows + np.arange(len(self.factors), dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def segments(self, text: np.ndarray) -> np.ndarray:
        """Minima over consecutive runs of `unit` shingles: (segments, functions)."""
        unit, step, parts = self.unit, 512 * self.unit, []
        for start in range(0, len(text), step):
            values = self.factors[:, None] * text[start : start + step]
            parts.append(np.minimum.reduceat(values, np.arange(0, values.shape[1], unit), axis=1).T)
        return np.concatenate(parts)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(position of the item, shared shingles, item's shingles) for each item that the text contains."""
        sequence = shingles(text)
        if not len(sequence) or not (self.partitions or self.short):
            return []
        candidates = set()
        if self.short:
            at = np.minimum(np.searchsorted(self.short_keys, sequence), len(self.short_keys) - 1)
            for key in distinct(sequence[self.short_keys[at] == sequence]).tolist():
                candidates.update(self.short[key])
        base = self.segments(sequence) if self.partitions else None
        for size, (seen, found) in self.partitions.items():
            lows = base
            if size > self.unit:
                lows = np.minimum.reduceat(base, np.arange(0, len(base), size // self.unit), axis=0)
            if len(lows) > 1:
                lows = np.minimum(lows[:-1], lows[1:])
            for window, function in zip(*np.nonzero(seen[self._slots(lows)])):
                candidates.update(found.get((int(function), int(lows[window, function])), ()))
        if not candidates:
            return []
        own, matched = distinct(sequence), []
        for k in sorted(candidates):
            wanted = self.items[k][1]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[at] == wanted).sum())
            if shared >= self.threshold * len(wanted) - 1e-9:
                matched.append((k, shared, len(wanted)))
        return matched


_INDEXES: dict[str, Index] = {}


def index(key: str, sent: Broadcast, threshold: float, recall: float) -> Index:
    """One index for each block and worker."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(sent.value, threshold, recall)
    return _INDEXES[key]


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[str, Broadcast]]:
    """The test items in blocks of about BLOCK_CHARS characters, each sent to the tasks."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    count = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(count):
        block = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in block.collect()])


def find(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    recall: float = RECALL,
) -> DataFrame:
    """One row for each document and test item it contains: id, item, containment, n_shared, n_item."""
    item_type = items.schema[item_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, item_type),
            T.StructField("containment", T.DoubleType()),
            T.StructField("n_shared", T.LongType()),
            T.StructField("n_item", T.LongType()),
        ]
    )

    def searched(key: str, sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index(key, sent, threshold, recall)
            for batch in batches:
                rows = [(k, own.items[i][0], shared / size, shared, size) for k, t in enumerate(batch.column(1)) for i, shared, size in own.search(t.as_py())]
                where, *columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_pydict(
                    {id_col: batch.column(0).take(pa.array(where, pa.int64())), item_col: list(columns[0]), "containment": list(columns[1]), "n_shared": list(columns[2]), "n_item": list(columns[3])},
                    pa.schema([(id_col, batch.schema.field(0).type), (item_col, kinds[item_col]), ("containment", pa.float64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]),
                )

        return run

    kinds = {item_col: to_arrow_schema(T.StructType([T.StructField(item_col, item_type)])).field(0).type}
    rows, result = docs.select(id_col, F.col(text_col).cast("string")), None
    for key, sent in _blocks(items, item_col, item_text_col):
        part = rows.mapInArrow(searched(key, sent), schema)
        result = part if result is None else result.unionByName(part)
    return result


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    at = docs.columns.index(text_col)

    def kept(key: str, sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index(key, sent, threshold, recall)
            for batch in batches:
                yield batch.filter(pa.array([not own.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return run

    for key, sent in _blocks(items, item_col, item_text_col):
        docs = docs.mapInArrow(kept(key, sent), docs.schema)
    return docs
