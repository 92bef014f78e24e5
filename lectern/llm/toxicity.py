"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

1. A bounded sample of labelled documents (`fit_rows`, in hash order of the id) gives learned lexicons: whole words, word
   beginnings and inner character runs that are in many toxic and few clean sample documents. With a fixed list of insults and
   patterns of shape (shouting, exclamation) they are the voters; each votes toxic or clean, or abstains.
2. All voters look at all documents. The label model is estimated on the counts of vote patterns over the whole corpus (as many
   rows as there are patterns, whatever the corpus holds): expectation-maximisation for the voters' accuracies given the hidden
   class; voters that stay correlated within a class are joined to cliques, whose joint votes are modelled together, and the
   accuracies are estimated anew. Sample documents take part with their known class.
3. A logistic regression from the documents' features to the posterior of their votes is fitted on the sample, and its
   output is calibrated on the sample's labels.

Defined cases: a null or empty text has no words, gets the features of an empty text and a score like any other; unlabelled
documents and null labels are not learned from; a repeated label counts once (the highest); with no labelled rows the fixed list alone
votes and nothing is calibrated; repeated rows are scored each; a text is read whole however long it is; an empty table gives an empty
result; `score` ignores other columns and `keep_clean` keeps them, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import jaccard
from lectern.session import materialize

FIT_ROWS = 30_000
REJECT_AT = 0.3
#: A learned item is in so many toxic sample documents, and its odds of being in a toxic document are so many times those of a clean one.
LEAST_DOCS = 5
STRONG, WEAK = 20.0, 4.0
#: Voters more correlated than this within a class are modelled together, up to so many: a clique of k voters has 3**k joint votes, and
#: one of all voters would explain any posterior.
CORRELATED, CLIQUE = 0.25, 4
CACHE = 300_000

# Common insults and slurs against persons, in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool fools jerk loser losers scum scumbag trash garbage clown clowns pathetic"
    " worthless disgusting disgrace vermin filth filthy imbecile retard retarded bastard bitch asshole shit crap fuck fucking fucker"
    " slut whore pig pigs coward cretin degenerate parasite creep twat wanker dickhead"
    " idiotin dumm dummkopf arschloch scheisse scheiße hurensohn wichser schlampe abschaum versager trottel depp missgeburt penner"
    " imbécile crétin connard connasse salaud salope pute merde débile abruti minable ordure bouffon"
    " idiota imbécil estúpido estúpida tonto gilipollas cabrón puta mierda basura asqueroso escoria payaso patético inútil".split()
)

WORD = re.compile(r"[^\W\d_]+")
#: A word of capitals.
UPPER = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}")
KINDS = ("insult", "word_strong", "word_weak", "start5_strong", "start5_weak", "start4_strong", "inner5_strong", "inner5_weak")


def items(word: str) -> Iterator[tuple[str, str]]:
    """What is learned about a word: itself, its beginnings, its inner runs of five letters."""
    yield "word", word
    if len(word) >= 6:
        yield "start5", word[:5]
    if len(word) >= 5:
        yield "start4", word[:4]
    for k in range(1, len(word) - 4):
        yield "inner5", word[k : k + 5]


class Lexicon:
    """Sets of learned items by kind; flags of tokens are remembered."""

    def __init__(self, learned: list[tuple[str, str, float]]):
        self.strength = {(kind, item): odds for kind, item, odds in learned}
        self.flags: dict[str, int] = {}

    def token(self, token: str) -> int:
        mask = 0
        for word in WORD.findall(token):
            mask |= word in INSULTS
            for kind, item in items(word):
                odds = self.strength.get((kind, item), 0.0)
                for name, least in ((f"{kind}_strong", STRONG), (f"{kind}_weak", WEAK)):
                    if odds >= least and name in KINDS:
                        mask |= 1 << KINDS.index(name)
                        break
        if len(self.flags) > CACHE:
            self.flags.clear()
        self.flags[token] = mask
        return mask

    def hits(self, text: str) -> tuple[list[int], int]:
        """Tokens of each kind, and all tokens."""
        tokens = text.lower().split()
        masks = list(map(self.flags.get, tokens))
        if None in masks:
            masks = [self.token(t) if m is None else m for m, t in zip(masks, tokens)]
        found = [0] * len(KINDS)
        for mask, n in Counter(masks).items():
            for k in range(len(KINDS)):
                if mask >> k & 1:
                    found[k] += n
        return found, len(tokens)

    def describe(self, text: str | None) -> tuple[list[float], int]:
        """Features of a text, and its votes as base-3 digits (0 abstains, 1 clean, 2 toxic)."""
        text = text or ""
        found, size = self.hits(text)
        upper = len(UPPER.findall(text)) / max(1, size)
        bangs = text.count("!!") / max(1, size)
        rates = [100.0 * n / max(1, size) for n in found]
        features = [float(min(n, 1)) for n in found] + [float(n > 1) for n in found] + [min(r, 20.0) for r in rates]
        features += [min(upper, 1.0), min(bangs, 1.0), float(np.log1p(size)), 1.0 if size < 5 else 0.0]
        votes = [2 if n else 0 for n in found] + [2 if n > 1 else 0 for n in (found[0], found[1], found[3])]
        votes += [2 if max(rates[0], rates[1], rates[3]) > 2 else 0, 2 if upper > 0.5 or bangs > 0.3 else 0]
        votes += [1 if not (found[0] or found[1] or found[3] or found[6]) else 0, 1 if not any(found) else 0]
        code = 0
        for vote in reversed(votes):
            code = code * 3 + vote
        return features, code


VOTERS = len(KINDS) + 7


def votes_of(code: int) -> list[int]:
    out = []
    for _ in range(VOTERS):
        code, vote = divmod(code, 3)
        out.append(vote)
    return out


_LEXICONS: dict[str, Lexicon] = {}


def lexicon(key: str, sent: Broadcast) -> Lexicon:
    """One lexicon for each model and worker."""
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(sent.value)
    return _LEXICONS[key]


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Ids, texts and labels of up to fit_rows labelled documents. The sample is bounded, so its ids are sent to the documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows).toArrow()
    chosen = docs.sparkSession.createDataFrame(chosen)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    return materialize(rows.select("__id", "text", "label"), "fit")


def learn_lexicon(fit: DataFrame) -> list[tuple[str, str, float]]:
    """(kind, item, odds ratio) of items that mark toxic texts; of copies and verified near copies the row with the smallest id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(*key, n) for key, n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "item", "label", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = {pair for word in set(WORD.findall((text.as_py() or "").lower())) for pair in items(word)}
                seen.update((kind, item, label) for kind, item in found)
            if len(seen) > CACHE:
                yield flush()
        yield flush()

    classes = jaccard.join(fit.select(F.col("__id").alias("doc_id"), "text")).select(F.col("doc_id").alias("__id"), "class_id").distinct()
    once = fit.join(classes.hint("merge"), "__id").groupBy("class_id").agg(F.min(F.struct("__id", "text", "label")).alias("r"))
    once = materialize(once.select("r.text", "r.label"), "once")
    totals = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counts = once.mapInArrow(run, "kind string, item string, label int, n long").groupBy("kind", "item")
    counts = counts.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = ((F.col("t") + 0.5) / (toxic + 1.0)) / ((F.col("c") + 0.5) / (clean + 1.0))
    # bounded by the items of the sample
    kept = counts.where((F.col("t") >= LEAST_DOCS) & (odds >= WEAK)).select("kind", "item", odds.alias("odds"))
    return [(r["kind"], r["item"], r["odds"]) for r in kept.collect()]


def describe(rows: DataFrame, key: str, sent: Broadcast, text_col: str, keep_text: bool = False) -> DataFrame:
    """The rows with __features and __votes, without their text unless it is kept."""
    kept = [c for c in rows.columns if c != text_col]
    rows = rows.select(*kept, F.col(text_col).cast("string").alias(text_col))
    own_columns = [*kept, text_col] if keep_text else kept
    schema = T.StructType([*(rows.schema[c] for c in own_columns), T.StructField("__features", T.ArrayType(T.FloatType())), T.StructField("__votes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon(key, sent)
        for batch in batches:
            found = [own.describe(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own_columns)], pa.array([f[0] for f in found], pa.list_(pa.float32())), pa.array([f[1] for f in found], pa.int64())], names=schema.names
            )

    return rows.mapInArrow(run, schema)


class LabelModel:
    """Hidden-class model of the votes: class share, and each clique's distribution over its joint votes given the class."""

    def __init__(self, patterns: list[tuple[int, int | None, float]]):
        """patterns: (votes, known class or None, weight)."""
        self.votes = np.array([votes_of(p) for p, _, _ in patterns], np.int64).reshape(len(patterns), VOTERS)
        self.weight = np.array([w for _, _, w in patterns], float)
        self.known = np.array([-1 if y is None else y for _, y, _ in patterns])
        self.cliques = [[k] for k in range(VOTERS)]
        start = np.clip(0.1 + 0.4 * (self.votes[:, :-2] == 2).sum(axis=1) - 0.08 * (self.votes == 1).sum(axis=1), 0.01, 0.99)
        self.posterior = np.where(self.known >= 0, self.known, start)
        self.estimate()
        self.correlate()
        self.estimate()

    def codes(self, votes: np.ndarray, clique: list[int]) -> np.ndarray:
        return votes[:, clique] @ (3 ** np.arange(len(clique)))

    def estimate(self, rounds: int = 50) -> None:
        for _ in range(rounds):
            before = self.posterior
            self.share = float(np.clip(self.weight @ self.posterior / max(self.weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
            self.tables = []
            for clique in self.cliques:
                codes, table = self.codes(self.votes, clique), np.full((2, 3 ** len(clique)), 0.1)
                np.add.at(table[1], codes, self.weight * self.posterior)
                np.add.at(table[0], codes, self.weight * (1 - self.posterior))
                self.tables.append(np.log(table / table.sum(axis=1, keepdims=True)))
            self.posterior = np.where(self.known >= 0, self.known, self.infer(self.votes))
            if np.abs(self.posterior - before).max(initial=0) < 1e-6:
                break

    def infer(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for clique, table in zip(self.cliques, self.tables):
            codes = self.codes(votes, clique)
            odds += table[1][codes] - table[0][codes]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def correlate(self) -> None:
        """Joins voters whose votes stay correlated when the class is given."""
        cast = (self.votes > 0).astype(float)
        total = np.zeros((VOTERS, VOTERS))
        for share in (self.posterior, 1 - self.posterior):
            weight = self.weight * share
            if weight.sum() < 1:
                continue
            centred = cast - weight @ cast / weight.sum()
            spread = np.sqrt(weight @ centred**2 / weight.sum()) + 1e-6
            total = np.maximum(total, np.abs((centred * weight[:, None]).T @ centred / weight.sum() / np.outer(spread, spread)))
        pairs = sorted(((total[i, j], i, j) for i in range(VOTERS) for j in range(i)), reverse=True)
        of = {k: [k] for k in range(VOTERS)}
        for strength, i, j in pairs:
            if strength > CORRELATED and of[i] is not of[j] and len(of[i]) + len(of[j]) <= CLIQUE:
                joined = sorted(of[i] + of[j])
                for k in joined:
                    of[k] = joined
        self.cliques = [list(c) for c in {tuple(c) for c in of.values()}]
        self.cliques.sort()


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton's method); y are probabilities, the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty * max(len(x), 1))
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        beta -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


@dataclass
class Model:
    key: str
    sent: Broadcast
    coefficients: list[float]
    intercept: float
    labels: LabelModel | None = None

    def score(self, features: Column) -> Column:
        """The calibrated probability, from the features column."""
        total = F.lit(self.intercept)
        for k, c in enumerate(self.coefficients):
            if c:
                total = total + features[k].cast("double") * F.lit(c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, whole: bool = False) -> tuple[Model, DataFrame]:
    """The model, and all documents' ids with their features and votes (a table in the shared folder); `whole` keeps the documents there too,
    the text as __text and the other columns in __rest."""
    chosen = sample(docs, labels, fit_rows, id_col, text_col, label_col)
    learned = learn_lexicon(chosen)
    sent, key = docs.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex
    if whole:
        rest = [c for c in docs.columns if c != text_col]
        described = describe(docs.select(F.struct(*rest).alias("__rest"), F.col(text_col).alias("__text")), key, sent, "__text", keep_text=True)
    else:
        described = describe(docs.select(id_col, text_col), key, sent, text_col)
    described = materialize(described, "features")
    table = describe(chosen, key, sent, "text").toArrow()  # bounded by fit_rows
    truth = np.array(table["label"].to_pylist(), float)
    votes = table["__votes"].to_pylist()
    patterns = [(r["__votes"], None, float(r["n"])) for r in described.groupBy("__votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns += [(v, int(y), float(n)) for (v, y), n in Counter(zip(votes, truth)).items()]
    model = LabelModel(patterns)
    if not len(truth):  # the fixed list alone: an insult is toxic
        return Model(key, sent, [6.0], -4.0, model), described
    x = np.array(table["__features"].to_pylist(), float)
    soft = model.infer(np.array([votes_of(v) for v in votes], np.int64))
    spread = x.std(axis=0)
    used = np.flatnonzero(spread > 1e-9)
    weights = np.zeros(x.shape[1] + 1)
    if len(used):
        mean, scale = x[:, used].mean(axis=0), spread[used]
        found = logistic((x[:, used] - mean) / scale, soft, 1e-4)
        weights[used] = found[:-1] / scale
        weights[-1] = found[-1] - (found[:-1] * mean / scale).sum()
    margin = x @ weights[:-1] + weights[-1]
    slope, shift = logistic(np.clip(margin, -30, 30)[:, None], truth, 1e-6) if 0 < truth.mean() < 1 else (1.0, 0.0)
    slope = max(float(slope), 1e-3)
    return Model(key, sent, [float(w * slope) for w in weights[:-1]], float(weights[-1] * slope + shift), model), described


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id and score of every row."""
    model, described = fit(docs, labels, id_col, text_col, label_col, fit_rows)
    return described.select(id_col, model.score(F.col("__features")).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents scored below reject_at, with all their columns."""
    model, described = fit(docs, labels, id_col, text_col, label_col, fit_rows, whole=True)
    kept = described.where(model.score(F.col("__features")) < reject_at)
    return kept.select(*[F.col("__text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("__rest").getField(c).alias(c) for c in docs.columns])
