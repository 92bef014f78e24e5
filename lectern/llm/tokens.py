"""Token counts of a unigram tokenizer without making the tokens (count-only Viterbi).

An Aho-Corasick automaton over the vocabulary lists all matches by their end; dynamic programming keeps, for each position,
the best score and the number of tokens of the path that has it. Ties follow the tokenizer: at one end the match that begins
first (the longest) is kept unless a later one scores strictly more; a character without a piece of its own gets the lowest
score less ten and counts as its UTF-8 bytes. As no piece holds a space mark or a line break past its start, whole texts are
counted as the sum over their space-separated chunks, exactly: scores in the vocabulary are whole numbers, so sums do not round.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct chunks whose count one worker remembers.
CACHE = 500_000


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Token counts of chunks; a chunk is what stands between spaces, with the line break before it if there is one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.split = not any(MARK in piece.lstrip(MARK) or "\n" in piece for piece, _ in pieces) and all(score == int(score) for _, score in pieces)

    def viterbi(self, text: str) -> int:
        """Tokens of the best path through a text in which spaces are already marks."""
        size = len(text)
        best = [0.0] * (size + 1)
        count = [0] * (size + 1)
        unknown, singles = self.unknown, set()
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, (length, score) in self.automaton.iter(text):
            matches[end].append((length, score))
            if length == 1:
                singles.add(end)
        for end in range(size):
            top, number = None, 0
            for length, score in sorted(matches[end], reverse=True) if len(matches[end]) > 1 else matches[end]:
                start = end + 1 - length
                candidate = best[start] + score
                if top is None or candidate > top:
                    top, number = candidate, count[start] + 1
            if end not in singles:
                candidate = best[end] + unknown
                if top is None or candidate > top:
                    top, number = candidate, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, number
        return count[size]

    def chunk(self, chunk: str) -> int:
        number = 1 + self.viterbi(chunk[1:]) if chunk[:1] == "\n" else self.viterbi(MARK + chunk)
        if len(self) < CACHE:
            self[chunk] = number
        return number

    def count(self, text: str | None) -> int:
        """Tokens of a whole text: a mark is put before it, spaces become marks."""
        if not text:
            return 0
        if not self.split or MARK in text or "  " in text or text[0] == " " or " \n" in text:
            marked = (MARK + text).replace(" ", MARK)
            return sum(map(self.viterbi, re.findall(f"{MARK}+[^{MARK}]*", marked))) if self.split else self.viterbi(marked)
        chunks = text.replace("\n", " \n").split(" ")
        if not chunks[0]:  # the text begins with a line break
            chunks[0] = "\n"
            head = self.viterbi(MARK)
            numbers = [head, *map(self.get, chunks[1:])]
        else:
            numbers = list(map(self.get, chunks))
        if None in numbers:
            count = self.chunk
            numbers = [count(c) if n is None else n for n, c in zip(numbers, chunks)]
        return sum(numbers)


@lru_cache(2)
def counter(model_path: str) -> Counter:
    return Counter(vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((count(t.as_py()) for t in batch.column(1)), pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
