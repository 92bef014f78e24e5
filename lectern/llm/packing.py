"""Best-fit packing of tokenised documents into fixed-size sequences (exact-complement hashing).

A document is its tokenizer ids followed by one end id. Longer documents are cut into full pieces, the remainder first.
Only the *number* of pieces of each length matters for the packing, so the plan is made on that histogram (at most
`capacity` counts, however large the corpus is): pieces whose lengths sum to exactly one sequence are found by
looking up the complement of single, pair and triple sums and consumed under their counts; what is left is packed best-fit,
longest first. The plan is a short list of patterns with multiplicities. Every piece then finds its place by its length and
its rank among pieces of that length; ranks come from per-salt counts, so no length is gathered in one task. The places are sent to the
tasks: each pattern uses up a length or an open run of sequences, so there are at most `capacity` squared of them, and some thousands in
practice, however many pieces there are.

Defined cases: a null or empty text is the end id alone (length 1); repeated rows are packed as often as they occur; an empty
table gives an empty result; a null id is kept and packed like any other row; a text is read whole however long it is; other columns
are ignored, whatever their names. No row is dropped.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.session import materialize

CAPACITY = 2048
END_ID = 0
#: Distinct words whose ids one worker remembers.
CACHE = 500_000

# The byte-level pre-tokenizer's split for texts of plain characters; letters come first as no contraction starts with one.
_SPLIT = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Plain characters: those on which the pattern above and the tokenizer's own Unicode classes agree.
_PLAIN_ASCII = bytes([10, *range(32, 127)])
_PLAIN_OTHER = frozenset("¡«»¿‐‑–—‘’“”„†…‧€" + "".join(chr(c) for c in range(0xC0, 0x250)))


class WordIds(dict):
    """Packed ids of a text chunk between spaces, remembered for up to CACHE chunks.

    A word's ids come from its vocabulary's merge ranks, the same merges that the tokenizer applies to that word.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        byte_of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte_of.__getitem__, token)): n for token, n in self.tokenizer.get_vocab().items() if token not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def part(self, part: str) -> bytes:
        ids = self.merge(part.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        """A chunk stands for itself after a space, or for itself alone where it starts with a line break."""
        found = b"".join(map(self.part, _SPLIT.findall(chunk if chunk[:1] == "\n" else f" {chunk}")))
        if len(self) < CACHE:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """The tokenizer's ids of a whole text, as little-endian unsigned 32-bit integers.

        Where single spaces and line breaks separate the words no token crosses them, so the text is looked up word by word;
        a text with other white space is split first, and one with other characters goes through the tokenizer as it is.
        """
        if not text:
            return b""
        other = text.encode("utf-8", "surrogatepass").translate(None, _PLAIN_ASCII)
        if "<|" in text or other and not _PLAIN_OTHER.issuperset(other.decode("utf-8", "surrogatepass")):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(self.part, _SPLIT.findall(text)))
        chunks = text.replace("\n", " \n").split(" ")
        packed = list(map(self.get, chunks))
        packed[0] = b"".join(map(self.part, _SPLIT.findall(chunks[0])))
        if None in packed:
            chunk = self.chunk
            packed = [chunk(c) if p is None else p for p, c in zip(packed, chunks)]
        return b"".join(packed)


@lru_cache(2)
def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


_PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full pieces, the remainder first."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: id, piece, start, length, ids_crc32."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer_path), struct.pack("<I", END_ID)
        for batch in batches:
            source, rows = [], []
            for k, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    source.append(k)
                    rows.append((n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every count exactly once.

    Longest lengths first, each is completed to exactly `capacity` by one, two or three others (pair sums are looked up in an
    index, a triple is a length and a pair). The rest is placed best-fit, in runs of equal patterns.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(left[n]) // k for n, k in need.items())
        if times <= 0:
            return False
        for n, k in need.items():
            left[n] -= k * times
        patterns.append((lengths, times))
        return True

    use((capacity,))
    for size in range(1, 4):
        for long in range(capacity - 1, 0, -1):
            while left[long] and complete(left, long, capacity - long, size, use):
                pass
    patterns += residual(left, capacity)
    return patterns


def complete(left: np.ndarray, long: int, gap: int, size: int, use) -> bool:
    """Use one combination of `size` lengths that fills the gap beside `long`; no part is longer than `long`."""
    if size == 1:
        return gap <= long and use((long, gap))
    if size == 2:
        have = np.flatnonzero(left[: min(long, gap - 1) + 1]) if gap > 1 else []
        have = [int(n) for n in have if left[gap - n] and n >= gap - n and gap - n > 0]
        return any(use((long, n, gap - n)) for n in reversed(have))
    have = np.flatnonzero(left[: min(long, gap - 2) + 1]) if gap > 2 else []
    for first in reversed(have):
        first, rest = int(first), gap - int(first)
        if 3 * first < gap:
            return False
        second = np.flatnonzero(left[: min(first, rest - 1) + 1])
        second = second[(second >= rest - second) & (left[rest - second] > 0)]
        if any(use((long, first, int(n), rest - int(n))) for n in second[::-1]):
            return True
    return False


def residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, over runs: equal pieces go into equally filled sequences many at a time."""
    bins: dict[int, list[list]] = {}  # free space -> runs [lengths, how many]
    free: list[int] = []

    def put(space: int, run: list) -> None:
        if space not in bins:
            bins[space] = []
            insort(free, space)
        bins[space].append(run)

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(free, length)
            if at == len(free):
                per = capacity // length
                whole, rest = divmod(count, per)
                if whole:
                    put(capacity - per * length, [(length,) * per, whole])
                if rest:
                    put(capacity - rest * length, [(length,) * rest, 1])
                count = 0
                continue
            space = free[at]
            run = bins[space][-1]
            per = min(space // length, count)
            times = min(run[1], count // per)
            run[1] -= times
            if not run[1]:
                bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    free.pop(at)
            put(space - per * length, [run[0] + (length,) * per, times])
            count -= per * times
        left[length] = 0
    return [(tuple(lengths), times) for runs in bins.values() for lengths, times in runs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of a length with these ranks go there in turn."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + times, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence_id and offset. See the module's text for the defined cases."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut_up.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).toLocalIterator()}
    slots = spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*places(plan(histogram, capacity)))) or [[]] * 5)], names=["length", "__lo", "__hi", "__sequence", "offset"]),
    )
    # at most `capacity` lengths times the number of salts
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = (
        salted.withColumn("__k", F.row_number().over(within))
        .join(counts.hint("shuffle_hash"), ["length", "__salt"])
        .withColumn("__rank", F.col("__before") + F.col("__k") - 1)
        .drop("__salt", "__k", "__before")
    )
    return (
        ranked.join(F.broadcast(slots), "length")
        .where("__rank >= __lo AND __rank < __hi")
        .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__sequence") + F.col("__rank") - F.col("__lo")).alias("sequence_id"), "offset")
    )
