"""Whitening of embeddings by exact principal components.

Vectors are rounded down to multiples of 1 / 256 and fitted on each distinct vector once. With n of them, sums S and products P, the integer matrix
n P - S S^T is n^2 times the covariance. It is summed exactly in tasks, as limbs of 32 bits that Spark adds up; d * d numbers come to
the driver for d dimensions, however many vectors there are. Its characteristic polynomial is found modulo many primes, one prime
at a time in tasks, and put together by Chinese remainders. The matrix is positive semidefinite, so all roots are real and sign changes count
them exactly; the largest are isolated to 160 bits after the point or more. Components are null vectors of the matrix at each root, by inverse
iteration in decimal arithmetic of more digits than the root has.

Defined cases: a row with a null vector, or with a null, NaN or infinite entry, is dropped; a shorter vector counts as filled up with
zeros; vectors of more than `MOST_DIMENSIONS` are an error; an empty table, vectors without dimensions, or fit vectors that are all equal, give an empty result; only components with a positive
eigenvalue are given, so there are fewer if the fit vectors span less; components of equal eigenvalues are some orthonormal basis;
an entry beyond a long's range takes the nearest long; a null id is an id like any other; repeated rows are each whitened; vectors may be
arrays of any numbers; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import polynomial
from lectern.session import materialize

STEP, COMPONENTS = 256, 4
#: The matrix has this number's square of entries at most, on the driver and in each task.
MOST_DIMENSIONS = 4096
LIMB, LIMBS = 32, 6
#: Rows of a block of exact products; with parts of 21 bits their sums are exact in doubles.
BLOCK, PART = 1024, 21


def rounded(vector: Column, step: int = STEP) -> Column:
    """The vector in whole steps, an array of longs; null if it or an entry is null or not finite."""
    entries = vector.cast("array<double>")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(whole, F.transform(entries, lambda c: F.floor(c * step)))


def block_of(column: pa.Array, d: int) -> np.ndarray:
    """A list column as a matrix of d columns; short vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (sizes == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def products(x: np.ndarray) -> np.ndarray:
    """x^T x of whole numbers, exactly, as Python integers. At most BLOCK rows."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    if most * most * len(x) < 2**53:
        floats = x.astype(np.float64)
        return (floats.T @ floats).astype(np.int64).astype(object)
    parts = []
    while most:
        low = x & (2**PART - 1)
        parts.append(low.astype(np.float64))
        x, most = x >> PART, most >> PART
    parts.append(x.astype(np.float64))  # the sign
    out = 0
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out = out + (a.T @ b).astype(np.int64).astype(object) * 2 ** (PART * (i + j))
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and products of the fit vectors, exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            block = block_of(batch.column(0), d)
            for at in range(0, len(block), BLOCK):
                x = block[at : at + BLOCK]
                n, product = n + len(x), product + products(x)
                total = total + x.astype(object).sum(axis=0)
        if n:
            upper = [(i, j) for i in range(d) for j in range(i, d)]
            cells = [(-1, -1, n), *((i, -1, total[i]) for i in range(d)), *((i, j, product[i, j]) for i, j in upper)]
            limbs = [[int(v) >> LIMB * k & (2**LIMB - 1) if k < LIMBS - 1 else int(v) >> LIMB * k for _, _, v in cells] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), *(pa.array(v, pa.int64()) for v in limbs)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    found = fit.mapInArrow(partial, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    values = {(r["i"], r["j"]): sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS)) for r in found.collect()}  # (d + 1) * (d + 2) / 2 rows
    matrix = [[values[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return values[-1, -1], [values[i, -1] for i in range(d)], matrix


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial of a positive semidefinite matrix; primes are dealt out to tasks."""
    d = len(matrix)
    bound = 2 * polynomial.coefficient_bound(sum(matrix[i][i] for i in range(d)), d)
    primes = polynomial.primes_for(bound)
    whole = np.array(matrix, object)

    def residues(batches):
        for batch in batches:
            for p in batch["p"]:
                yield batch.head(1).assign(p=p, values=[polynomial.characteristic_modulo((whole % int(p)).astype(np.int64), int(p))])

    # one row for each prime: about d * log2(trace) / 31, whatever the number of vectors
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, min(len(primes) // 4, spark.sparkContext.defaultParallelism)))
    return polynomial.remaindered({r["p"]: list(r["values"]) for r in rows.mapInPandas(residues, "p long, values array<long>").collect()})


class Model:
    """What whitening needs: n, the sums, the components, the roots of n^2 times the covariance (as fractions) and the shares of variance."""

    def __init__(self, n: int, sums: list[int], vectors: list[list[float]], roots: list[Fraction], trace: int):
        self.n, self.sums = n, sums
        self.vectors = np.array(vectors).T  # d x k
        self.explained = [float(r / trace) for r in roots]
        # square roots of the eigenvalues times n, to more bits than a double has
        self.scales = np.array([float(Fraction(isqrt((r.numerator << 256) // r.denominator), 1 << 128)) for r in roots])

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit whole numbers where they are sure to fit, with their squares' sums, else Python integers."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        kind = np.int64 if most * most * x.shape[1] < 2**63 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, differences: np.ndarray) -> np.ndarray:
        return differences.astype(np.float64) @ self.vectors / self.scales


def learn(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a table of one column of distinct whole vectors; None if there is nothing to whiten."""
    d = fit.agg(F.max(F.size(fit.columns[0]))).first()[0]
    if not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions, more than {MOST_DIMENSIONS}")
    n, sums, square = moments(fit, d)
    matrix = [[n * square[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None
    coefficients = characteristic(fit.sparkSession, matrix)
    positive = next(d - k for k, c in enumerate(coefficients) if c)  # zero roots are trailing zero coefficients
    roots = polynomial.largest_roots(coefficients, min(components, positive), trace)
    vectors = [v for root in dict.fromkeys(roots) for v in polynomial.null_vectors(matrix, root, roots.count(root))]
    return Model(n, sums, vectors, [Fraction(2 * top + 1, 2 << bits) for top, bits in roots], trace)


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit vectors' covariance less the identity."""
    k = len(model.scales)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(model.differences(block_of(batch.column(0), len(model.sums)))) if batch.num_rows else np.zeros((0, k))
            total, product = total + w.sum(axis=0), product + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*total, *(product[i, j] for i, j in upper)]], names=names)

    names = [*(f"s{i}" for i in range(k)), *(f"p{i}_{j}" for i, j in upper)]
    found = fit.mapInArrow(partial, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    # the vectors are centred by their exact sums before they are whitened; what rounding leaves of the mean is taken off here
    mean = [found[f"s{i}"] / model.n for i in range(k)]
    return max(abs(found[f"p{i}_{j}"] / model.n - mean[i] * mean[j] - (i == j)) for i, j in upper)


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, step: int = STEP) -> DataFrame:
    """id, component, n, deviation (the sum of the squares of n x - S, exact), whitened, explained and identity_error for every vector and component."""
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).alias("id"), rounded(F.col(vector_col), step).alias("x")).where("x IS NOT NULL")
    fit = materialize(rows.select("x").distinct(), "fit")
    model = learn(fit, components)
    schema = f"`{id_col}` {kind.simpleString()}, {RESULT}"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k, error = len(model.sums), len(model.scales), identity_error(fit, model)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differences = model.differences(block_of(batch.column(1), d))
            deviation = [int(v) if v < 10**38 else None for v in (differences * differences).sum(axis=1).tolist()]
            repeat = lambda values, kind: pa.array(np.repeat(values, k), kind)
            many = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(repeat(np.arange(many), pa.int64())),
                    pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                    pa.array([model.n] * (many * k), pa.int64()),
                    repeat(np.array(deviation, object), pa.decimal128(38, 0)),
                    pa.array(model.whitened(differences).ravel(), pa.float64()),
                    pa.array(np.tile(model.explained, many), pa.float64()),
                    pa.array([error] * (many * k), pa.float64()),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(every, schema)
