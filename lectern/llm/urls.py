"""URL filtering: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models, one of accepted and one of rejected URLs (those the rules decide), are counted by Spark over
all rows. A character's probability is interpolated from contexts of 0 to `order` characters with Witten-Bell weights, so a
context that was never seen passes the word to the next shorter one. The score of a URL is the difference of the two
log-likelihoods per character; the threshold is calibrated on rule-decided URLs held out of the counts by their hash, at
the point where as large a share of accepted URLs falls below it as of rejected URLs above it.

Every context counts, however rare, so the model grows with the input and stays a Spark table. Where a character's step is looked up
depends on how frequent its context and character are, its value does not: pairs that make up at least `sent_share` of a
class's characters are sent to the tasks with their exact counts (2 * (order + 1) / sent_share pairs at most); the distinct
others of all URLs are joined with the tables, and the sums come back to the rows.

Defined cases: a null URL, or one without `://`, has empty host and path, fits no rule and is judged by its characters (a null
one has none and scores 0); with no rule-decided URL at all everything else is allowed; repeated rows are judged alike; a URL is read
whole however long it is; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import materialize

ORDER = 5
SENT_SHARE = 2e-5
#: One in so many rule-decided URLs is held out for calibration.
HELD_OUT = 5
#: Bins of the score, over which the calibration counts.
BIN = 0.01
START, END = "\x02", "\x03"
FLUSH, CACHE = 300_000, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (like `example.net/en/`) whose host is the URL's or a parent of it and whose path begins the URL's."""
    chosen = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        chosen = F.when(fits, F.lit(text)).otherwise(chosen)
    return chosen


def _context_counts(urls: DataFrame, order: int) -> DataFrame:
    """Counts of (verdict, context, next character) over all URLs."""

    def flush(seen: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(verdict, gram[:-1], gram[-1], n) for verdict, grams in seen.items() for gram, n in grams.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["verdict", "context", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for verdict, url in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = START + url.as_py() + END
                own = seen.setdefault(verdict, Counter())
                for size in range(1, order + 2):
                    own.update(text[k - size : k] for k in range(max(2, size), len(text) + 1))
            if sum(map(len, seen.values())) > FLUSH:
                yield flush(seen)
        if seen:
            yield flush(seen)

    schema = "verdict string, context string, next string, n long"
    return urls.select("verdict", "__url").mapInArrow(run, schema).groupBy("verdict", "context", "next").agg(F.sum("n").alias("n"))


class Ratio:
    """Log-likelihood differences (accepted minus rejected) of the pairs that were sent, the other pairs of a URL."""

    def __init__(self, rows: list[tuple], alphabet: int, order: int):
        """rows: context, next character, then count, sum and kinds of the context for each class (see _pairs)."""
        self.order, self.alphabet = order, alphabet
        self.pairs = {(r[0], r[1]): r[2:] for r in rows}
        self.known: dict[tuple[str, str], tuple[float, ...]] = {}

    def step(self, context: str, following: str) -> tuple[float, ...]:
        """Size of the longest sent context (-1: none), and both classes' probabilities by it."""
        key = context, following
        found = self.known.get(key)
        if found is None:
            base, chances = -1, [1.0 / self.alphabet] * 2
            for size in range(len(context) + 1):
                pair = self.pairs.get((context[len(context) - size :], following))
                if pair is None:
                    break
                base, chances = size, [blend(chance, *pair[3 * k : 3 * k + 3]) for k, chance in enumerate(chances)]
            found = base, *chances, math.log(chances[0]) - math.log(chances[1])
            if len(self.known) < CACHE:
                self.known[key] = found
        return found

    def split(self, url: str | None) -> tuple[float, int, list[tuple]]:
        """Sum of the steps that are known in full, the number of steps, and (context, next, base, allow, block) of the others."""
        if url is None:
            return 0.0, 0, []
        text, total, others = START + url + END, 0.0, []
        for k in range(1, len(text)):
            context = text[max(0, k - self.order) : k]
            base, allow, block, step = self.step(context, text[k])
            if base == len(context):
                total += step
            else:
                others.append((context, text[k], base, allow, block))
        return total, len(text) - 1, others


def blend(chance: float, n: int, total: int, kinds: int) -> float:
    """Witten-Bell: the next shorter context's probability and this one's counts; a context never seen passes it on."""
    return (n + kinds * chance) / (total + kinds) if total else chance


def _pairs(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, next, n_allow, n_block), and (context, sum_allow, kinds_allow, sum_block, kinds_block)."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    pairs = counts.groupBy("context", "next").agg(n("allow").alias("n_allow"), n("block").alias("n_block"))
    sums = counts.groupBy("context").agg(*[c for v in ("allow", "block") for c in (n(v).alias(f"sum_{v}"), F.count_if(F.col("verdict") == v).alias(f"kinds_{v}"))])
    return materialize(pairs, "pairs"), materialize(sums, "sums")


def _steps(asked: DataFrame, pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """(context, next, step) of the asked (context, next, base, allow, block): the contexts longer than base are looked up."""
    one = asked.groupBy("context", "next").agg(*[F.first(c).alias(c) for c in ("base", "allow", "block")])  # equal within a group
    sizes = F.explode(F.sequence(F.col("base") + 1, F.length("context")))
    longer = one.select("*", sizes.alias("size")).withColumn("suffix", F.expr("substring(context, length(context) - size + 1, size)"))
    longer = longer.join(sums.withColumnRenamed("context", "suffix").hint("merge"), "suffix", "left")
    longer = longer.join(pairs.withColumnRenamed("context", "suffix").hint("merge"), ["suffix", "next"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    parts = F.struct("size", *[zero(f"{what}_{v}").alias(f"{what}_{v}") for v in ("allow", "block") for what in ("n", "sum", "kinds")])
    found = longer.groupBy("context", "next").agg(F.first("allow").alias("allow"), F.first("block").alias("block"), F.array_sort(F.collect_list(parts)).alias("parts"))

    def chance(v: str) -> Column:
        return F.aggregate("parts", F.col(v), lambda c, p: F.when(p[f"sum_{v}"] > 0, (p[f"n_{v}"] + p[f"kinds_{v}"] * c) / (p[f"sum_{v}"] + p[f"kinds_{v}"])).otherwise(c))

    return found.select("context", "next", (F.log(chance("allow")) - F.log(chance("block"))).alias("step"))


_RATIOS: dict[str, Ratio] = {}


def _ratio(key: str, sent, order: int) -> Ratio:
    if key not in _RATIOS:
        _RATIOS.clear()
        _RATIOS[key] = Ratio(*sent.value, order)
    return _RATIOS[key]


def filter_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", order: int = ORDER, sent_share: float = SENT_SHARE) -> DataFrame:
    """id, host, path, rule, verdict, score and threshold of every row; `rules` gives each rule's verdict, block or allow."""
    spark = pages.sparkSession
    named = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"))
    named = named.withColumn("host", host(F.col("__url"))).withColumn("path", path(F.col("__url")))
    named = named.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for text, verdict in rules.items():
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    named = named.withColumn("verdict", by_rule)
    held_out = F.pmod(F.xxhash64("__url"), F.lit(HELD_OUT)) == 0

    decided = named.where(F.col("verdict").isNotNull())
    counts = materialize(_context_counts(decided.where(~held_out), order), "contexts")
    pairs, sums = _pairs(counts)
    totals = [r or 0 for r in sums.where("context = ''").agg(F.sum("sum_allow"), F.sum("sum_block")).first()]
    alphabet = max(2, counts.select("next").distinct().count()) + 1
    frequent = (F.col("n_allow") >= max(1, totals[0] * sent_share)) | (F.col("n_block") >= max(1, totals[1] * sent_share))
    # bounded: see the module's text
    table = pairs.where(frequent).join(sums.hint("merge"), "context").select("context", "next", "n_allow", "sum_allow", "kinds_allow", "n_block", "sum_block", "kinds_block").toArrow()
    rows = list(zip(*(c.to_pylist() for c in table.columns)))
    sent, key = spark.sparkContext.broadcast((rows, alphabet)), uuid.uuid4().hex
    other = "array<struct<context:string,next:string,base:int,allow:double,block:double>>"
    kept = named.withColumn("__held", held_out).withColumn("__row", F.monotonically_increasing_id())
    fields = [*kept.schema.fields, T.StructField("__sum", T.DoubleType()), T.StructField("__size", T.LongType()), T.StructField("__others", T.DataType.fromDDL(other))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = _ratio(key, sent, order)
        names = ("context", "next", "base", "allow", "block")
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64())))))
        for batch in batches:
            at = batch.schema.get_field_index("__url")
            found = [ratio.split(u.as_py()) for u in batch.column(at)]
            others = pa.array([[dict(zip(names, o)) for o in f[2]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), others], names=[*batch.schema.names, "__sum", "__size", "__others"])

    split = materialize(kept.mapInArrow(run, T.StructType(fields)).drop("__url"), "split")
    others = split.select("__row", F.explode("__others").alias("o")).select("__row", "o.*")
    more = others.join(_steps(others, pairs, sums).hint("merge"), ["context", "next"]).groupBy("__row").agg(F.sum("step").alias("__more"))
    scored = split.drop("__others").join(more.hint("merge"), "__row", "left")
    scored = materialize(scored.withColumn("score", F.when(F.col("__size") > 0, (F.col("__sum") + F.coalesce("__more", F.lit(0.0))) / F.col("__size")).otherwise(0.0)), "scored")
    threshold = calibrate(scored.where(F.col("verdict").isNotNull() & F.col("__held"))) if rows else -math.inf
    judged = F.when(F.col("score") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def calibrate(scored: DataFrame) -> float:
    """The bin edge at which the shares of wrongly judged accepted and rejected URLs are closest; 0 if a class is missing."""
    bins = scored.groupBy(F.round(F.col("score") / BIN).cast("long").alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    rows = sorted(tuple(r) for r in bins.collect())  # bounded by the range of a mean log ratio over BIN
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, threshold, below, above = math.inf, 0.0, 0, bad
    for edge, own_good, own_bad in rows:
        gap = abs(below / good - above / bad)
        if gap < best:
            best, threshold = gap, (edge - 0.5) * BIN
        below, above = below + own_good, above - own_bad
    return threshold
