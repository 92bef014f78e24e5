"""Language identification by words first, backing off to shorter and shorter character n-grams.

Learning counts every word of every training text for each language, and from the word counts every character n-gram; both
counts are made by Spark over all training rows and stay Spark tables. Every word and n-gram of the training texts is known,
however rare, so the model grows with the corpus.

A text's score for a language is the sum of its words' log frequencies; a word that is not known is scored by the mean log
frequency of its longest known n-grams (lengths 5 down to 1), one that has none by nothing. The prediction is the best
language (ties: first by name), its score the posterior probability among the learned languages.

Where a word's vector of log frequencies is looked up depends on how frequent it is, its value does not. The vectors of words that
make up at least `sent_share` of some language are sent to the tasks: languages / sent_share words at most. A text's other words
are joined with the tables: the distinct ones get their vectors there, and the sums come back to the rows.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned; training
rows with a null language or text are not learned from; repeated rows count each; a text is read whole, in blocks, however long it is; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.words import BLOCK, code_points, letter_chars, mix, run_hashes
from lectern.session import materialize

UNDETERMINED = "und"
SENT_SHARE = 2e-6
LENGTHS = (5, 4, 3, 2, 1)
#: Code points of the texts or words that are counted at once.
LEARN_BLOCK = 1 << 21


COUNTED = "lang string, size int, item string, n long"


def _tally(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys, and their (weighted) counts."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else order
    if weights is None:
        return order[first], np.diff(np.append(first, len(keys)))
    return order[first], np.add.reduceat(weights[order], first) if len(keys) else weights


def _rows(langs: list[str], of: np.ndarray, size: int, items: list[str], n: np.ndarray) -> pa.RecordBatch:
    lang = pa.DictionaryArray.from_arrays(pa.array(of, pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(items), size), pa.int32()), pa.array(items, pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "item", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The batches' rows (lang, text, ...) in groups of LEARN_BLOCK code points or more."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[1]) + 3
            if size >= LEARN_BLOCK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words (size 0) of (lang, text), for each block of texts."""
    for rows in _gathered(batches):
        langs = sorted({r[0] for r in rows})
        numbers = np.array([langs.index(r[0]) for r in rows])
        for text, own, starts in _blocks([r[1] for r in rows], LEARN_BLOCK):
            begin, end, hashes = _letter_runs(text)
            lang = numbers[own[np.searchsorted(starts, begin, "right") - 1]]
            at, n = _tally(hashes + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), None)
            yield _rows(langs, lang[at], 0, [text[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist())], n)


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of counted words (lang, word, n), for each block of words; `^` and `$` mark a word's ends."""
    for rows in _gathered(batches):
        langs = sorted({r[0] for r in rows})
        numbers, counts = np.array([langs.index(r[0]) for r in rows]), np.array([r[2] for r in rows], np.int64)
        text = "\n".join(f"^{r[1]}$" for r in rows)
        codes = code_points(text).astype(np.uint64)
        word = np.cumsum(codes == 10)
        for size in LENGTHS:
            inside = np.flatnonzero((word[: len(word) - size + 1] == word[size - 1 :]) & (codes[: len(codes) - size + 1] != 10)) if len(codes) >= size else np.empty(0, int)
            keys = mix(numbers[word[inside]].astype(np.uint64) + np.uint64(1))
            for k in range(size):
                keys = mix(keys + codes[inside + k])
            at, n = _tally(keys, counts[word[inside]])
            places = inside[at]
            yield _rows(langs, numbers[word[places]], size, [text[b : b + size] for b in places.tolist()], n)


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """All words (size 0) and n-grams of the training texts: lang, size, item, n, with the language's total."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    total = lambda found: found.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    words = materialize(total(rows.mapInArrow(_count_words, COUNTED)), "words")
    ngrams = total(words.select("lang", "item", "n").mapInArrow(_count_ngrams, COUNTED))
    counts = materialize(words.unionByName(ngrams), "counts")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), ["lang", "size"])  # a row for each language and size


def _vectors(model: DataFrame, langs: list[str], totals: dict[tuple[str, int], int], sent_share: float) -> DataFrame:
    """size, item, logs (its log frequency in every language), and sent: is it frequent in one."""
    norms = F.create_map(*[F.lit(x) if isinstance(x, int) else x for size in (0, *LENGTHS) for x in (size, F.array(*[F.lit(math.log(totals.get((lang, size), 0) + 1.0)) for lang in langs]))])
    items = model.groupBy("size", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"), F.max(F.col("n") >= F.col("total") * sent_share).alias("sent"))
    logs = [(F.log(F.coalesce(F.col("m").getItem(lang), F.lit(0)) + 0.5) - norms[F.col("size")][k]).cast("float") for k, lang in enumerate(langs)]
    return items.select("size", "item", F.array(*logs).alias("logs"), "sent")


class Summer:
    """Sums of the sent words' vectors over texts, and the texts' other words. Words are looked up by their 64-bit hashes."""

    def __init__(self, words: list[str], logs: np.ndarray):
        hashes = np.concatenate([_letter_runs(part)[2] for part, _, _ in _blocks(words)]) if words else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.logs = np.append(hashes[order], np.iinfo(np.uint64).max), np.vstack([logs[order], np.zeros((1, logs.shape[1]), logs.dtype)]).astype(float)

    def __getstate__(self) -> tuple:
        return self.hashes, self.logs

    def __setstate__(self, state: tuple) -> None:
        self.hashes, self.logs = state

    def block(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For lower-cased texts that lie in one string from `starts`: how many words each has, its sum, and the other words: text, count, word."""
        begin, end, hashes = _letter_runs(text)
        of = np.searchsorted(starts, begin, "right") - 1
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[at] == hashes
        sums = np.stack([np.bincount(of[known], self.logs[at[known], k], len(starts)) for k in range(self.logs.shape[1])], axis=1)
        of_other, hashes, begin, end = of[~known], hashes[~known], begin[~known], end[~known]
        order = np.lexsort((hashes, of_other))
        of_other, hashes, begin, end = of_other[order], hashes[order], begin[order], end[order]
        first = np.flatnonzero(np.concatenate(([True], (of_other[1:] != of_other[:-1]) | (hashes[1:] != hashes[:-1])))) if len(order) else order
        counts = np.diff(np.append(first, len(order)))
        return np.bincount(of, minlength=len(starts)), sums, of_other[first], counts, [text[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist())]

    def split(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For every text the sum of its sent words (null without a letter), its other words and their counts."""
        sums, none, of, counts, words = np.zeros((len(texts), self.logs.shape[1])), np.ones(len(texts), bool), [], [], []
        for part, rows, starts in _blocks(texts):
            found, total, own, n, other = self.block(part, starts)
            np.add.at(sums, rows, total)
            none[rows[found > 0]] = False
            of.append(rows[own])
            counts.append(n)
            words.extend(other)
        of = np.concatenate(of) if of else np.empty(0, int)  # ascending, as the blocks follow the texts
        offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        counts = pa.array(np.concatenate(counts) if counts else [], pa.int32())
        rows = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), self.logs.shape[1]).cast(pa.list_(pa.float64()))
        rows = pa.ListArray.from_arrays(rows.offsets, rows.values, mask=pa.array(none)) if none.any() else rows
        return rows, pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, counts)


def _letter_runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = code_points(text)
    return run_hashes(codes, letter_chars()[codes])


def _blocks(texts: list[str | None], block: int = BLOCK) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Lower-cased texts joined to strings of about `block` code points, with their rows and starts; a longer text is cut between words."""
    parts, rows, starts, size = [], [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while True:
            end = at + block
            while end < len(text) and text[end].isalnum():
                end += 1
            if size + min(end, len(text)) - at > block and parts:
                yield "\n".join(parts), np.array(rows), np.array(starts)
                parts, rows, starts, size = [], [], [], 0
            part = text[at:end]
            parts.append(part)
            rows.append(row)
            starts.append(size)
            size += len(part) + 1
            at = end
            if at >= len(text):
                break
    if parts:
        yield "\n".join(parts), np.array(rows), np.array(starts)


def _looked_up(words: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """word and logs of the words: their own, or the mean of their longest known n-grams; words without either are left out.

    The words that are not known yet are asked with shorter and shorter n-grams, a table for each length.
    """
    own = vectors.where("size = 0").select(F.col("item").alias("word"), "logs")
    asked = materialize(words.join(own.hint("merge"), "word", "left"), "asked")
    found = asked.where("logs IS NOT NULL")
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    for size in LENGTHS:
        left = asked.where("logs IS NULL").select("word")
        if left.isEmpty():
            break
        runs = F.transform(F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda k: F.substring(padded, k, F.lit(size)))
        grams = left.where(F.length(padded) >= size).select("word", F.explode(runs).alias("item"))
        known = vectors.where(F.col("size") == size).select("item", "logs")
        means = grams.join(known.hint("merge"), "item").groupBy("word").agg(F.array(*[F.avg(F.col("logs")[k]).cast("float") for k in range(width)]).alias("logs"))
        asked = materialize(left.join(means.hint("merge"), "word", "left"), "asked")
        found = found.unionByName(asked.where("logs IS NOT NULL"))
    return found


def identify(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_share: float = SENT_SHARE) -> DataFrame:
    """id, lang_pred and score of every row; `model` comes from learn()."""
    totals = {(r["lang"], r["size"]): r["total"] for r in model.select("lang", "size", "total").distinct().collect()}  # one row for each language and size
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return docs.select(id_col, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    vectors = materialize(_vectors(model, langs, totals, sent_share), "vectors")
    # bounded: see the module's text
    frequent = vectors.where("size = 0 AND sent").select("item", "logs").toArrow()
    logs = frequent["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    sent = docs.sparkSession.sparkContext.broadcast(Summer(frequent["item"].to_pylist(), logs))
    schema = T.StructType(
        [T.StructField("__row", T.LongType()), T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__sum", T.ArrayType(T.DoubleType())), T.StructField("__words", T.ArrayType(T.StringType())), T.StructField("__counts", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summer = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *summer.split(batch.column(2).to_pylist())], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = materialize(rows.mapInArrow(run, schema), "sums")
    others = rows.select("__row", F.explode(F.arrays_zip(F.col("__words").alias("word"), F.col("__counts").alias("n"))).alias("w")).select("__row", "w.word", "w.n")
    found = _looked_up(others.select("word").distinct(), vectors, len(langs))
    more = others.join(found.hint("merge"), "word").groupBy("__row").agg(F.array(*[F.sum(F.col("logs")[k].cast("double") * F.col("n")) for k in range(len(langs))]).alias("__more"))
    rows = rows.select("__row", "__id", "__sum").join(more.hint("merge"), "__row", "left")
    total = F.when(F.col("__more").isNull(), F.col("__sum")).otherwise(F.zip_with("__sum", "__more", lambda a, b: a + b))
    rows = rows.select("__id", total.alias("__total")).select("__id", "__total", F.array_max("__total").alias("__best"))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("__total", F.col("__best")).cast("int"))
    share = 1.0 / F.aggregate("__total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__best")))
    return rows.select(F.col("__id").alias(id_col), F.when(F.col("__best").isNull(), UNDETERMINED).otherwise(best).alias("lang_pred"), F.when(F.col("__best").isNull(), 0.0).otherwise(share).alias("score"))
