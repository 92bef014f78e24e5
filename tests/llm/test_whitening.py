import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lectern.llm import polynomial, whitening
from lectern.llm.queries import op13_whitening


def plain(rows):
    """By the contract, with fractions, and numpy's eigenvectors."""
    left = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in left})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    scatter = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(scatter, float) / n**2)
    return left, n, sums, scatter, values[::-1], vectors[:, ::-1]


def compare(rows, found, components=4):
    left, n, sums, scatter, values, vectors = plain(rows)
    assert len(found) == len(left) * components
    got = {(r["vec_id"], r["component"]): r for r in found}
    trace = sum(values)
    for k in range(components):
        mine = np.array([got[i, k + 1]["whitened"] for i, _ in left])
        theirs = np.array([sum((Fraction(c) - Fraction(s, n)) * Fraction(float(v)) for c, s, v in zip(x, sums, vectors[:, k])) / Fraction(math.sqrt(values[k])) for _, x in left], float)
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert {round(got[i, k + 1]["explained"], 9) for i, _ in left} == {round(values[k] / trace, 9)}
    for i, x in left:
        assert int(got[i, 1]["deviation"]) == sum((n * c - s) ** 2 for c, s in zip(x, sums)) and got[i, 1]["n"] == n
    assert 0 <= found[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in found}) == 1


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = op13_whitening(spark, SMALL)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(rows, found.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, component int"


def test_awkward_vectors(spark):
    draw = random.Random(1)
    rows = [(k, [draw.gauss(0, 1) * (j + 1) for j in range(6)]) for k in range(80)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, rows[3][1]), (105, [-0.0] * 6), (106, [0.0] * 6)]
    rows += [(107 + k, rows[5][1]) for k in range(60)]  # many copies count once
    table = spark.createDataFrame([(*r, 1, 2, "x", 9) for r in rows], SCHEMA)
    compare(rows, whitening.whiten(table).collect())


def test_few_dimensions_and_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None)])).collect() == []  # all equal
    assert whitening.whiten(frame([(1, []), (2, [])])).collect() == []
    found = whitening.whiten(frame([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (2, [3.0])])).collect()  # the last is [3, 0]
    assert len(found) == 6 and {r["component"] for r in found} == {1, 2} and found[0]["identity_error"] < 1e-9
    line = whitening.whiten(frame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).collect()
    assert len(line) == 5 and {r["component"] for r in line} == {1} and line[0]["explained"] == 1.0
    corners = whitening.whiten(frame([(8 * s + k, [float(s * (j == k)) for j in range(5)]) for k in range(5) for s in (-1, 1)])).collect()  # five equal eigenvalues
    assert len(corners) == 40 and corners[0]["identity_error"] < 1e-9 and abs(corners[0]["explained"] - 0.2) < 1e-12


def test_very_large_entries(spark):
    draw = random.Random(3)
    rows = [(k, [draw.uniform(-3e16, 3e16) for _ in range(4)]) for k in range(30)] + [(40, [1e300, 0.0, 0.0, -1e300])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    whole = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v] for i, v in rows}
    n, sums = len(rows), [sum(x) for x in zip(*whole.values())]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in whole.items()}
    assert {r["vec_id"]: None if r["deviation"] is None else int(r["deviation"]) for r in found} == {i: v if v < 10**38 else None for i, v in exact.items()}


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_characteristic_polynomial(size):
    draw = random.Random(size)
    rows = [[draw.randint(-9, 9) for _ in range(size)] for _ in range(size + 2)]
    matrix = [[sum(r[i] * r[j] for r in rows) for j in range(size)] for i in range(size)]
    # Faddeev and LeVerrier
    m, c = [[Fraction(0)] * size for _ in range(size)], [Fraction(1)]
    for k in range(1, size + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(size)) + (c[-1] if i == j else 0) for j in range(size)] for i in range(size)]
        c.append(-sum(sum(matrix[i][t] * m[t][i] for t in range(size)) for i in range(size)) / k)
    primes = polynomial.primes_for(2 * polynomial.coefficient_bound(sum(matrix[i][i] for i in range(size)), size))
    residues = {p: polynomial.characteristic_modulo(np.array(matrix) % p, p).tolist() for p in primes}
    assert polynomial.remaindered(residues) == c[::-1]


def test_roots_near_each_other():
    times = lambda a, b: [sum(a[i] * b[k - i] for i in range(len(a)) if 0 <= k - i < len(b)) for k in range(len(a) + len(b) - 1)]
    p = [1]
    for root in (7, 7, 3, 0):
        p = times(p, [-root, 1])
    p = times(p, [-(10**30 + 1), 10**30 - 0])  # 1 + 1e-30
    p = times(p, [-1, 1])
    found = polynomial.largest_roots(p, 6, 10)
    near = [Fraction(a, 1 << b) for a, b in found]
    assert [round(float(r), 6) for r in near] == [7, 7, 3, 1, 1, 0] and found[0] == found[1]
    assert abs(near[3] - near[4] - Fraction(1, 10**30)) < Fraction(1, 2**159)


def test_vectors_of_close_roots():
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))[0]
    whole = np.round(turn @ np.diag([9, 7, 5, 3, 1]) * 1e6).astype(int)
    matrix = (whole @ whole.T).tolist()
    p = polynomial.primes_for(2 * polynomial.coefficient_bound(int(np.trace(np.array(matrix))), 5))
    c = polynomial.remaindered({q: polynomial.characteristic_modulo(np.array(matrix) % q, q).tolist() for q in p})
    values, vectors = np.linalg.eigh(np.array(matrix, float))
    for k, root in enumerate(polynomial.largest_roots(c, 5, sum(matrix[i][i] for i in range(5)))):
        (mine,) = polynomial.null_vectors(matrix, root, 1)
        assert abs(root[0] / 2 ** root[1] / values[-1 - k] - 1) < 1e-9 and abs(abs(np.dot(mine, vectors[:, -1 - k])) - 1) < 1e-9


def test_null_ids_stay(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), ("a", [2.0, 5.0])], "vec_id string, embedding array<double>")
    assert whitening.whiten(table).where(F.col("vec_id").isNull()).count() == 4
