"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so the scatter matrix n * X'X - SS' (n squared times the covariance) is known
exactly. Its characteristic polynomial is computed modulo many primes (Hessenberg reduction, one Spark
task per handful of primes) and put together by the Chinese remainder theorem. All roots are real, so
by Descartes' rule the sign changes of the shifted polynomial count the roots above any point exactly,
with their multiplicity; bisection isolates each of the largest roots to ROOT_BITS binary digits. The
components are null vectors: inverse iteration in long fixed-point numbers, orthogonal within a
multiple root. The polynomial, roots and vectors depend on the number of dimensions only.

Cases: vectors that are null or empty, or hold a null, a non-finite entry or one whose 1024-fold is no
long, are dropped; so are those of another length than the most frequent one (the longest of several).
Components of variance zero have no whitened value: constant or few vectors give fewer components, one
vector or an empty table no rows. A deviation of over 38 digits is null. Equal rows are all counted; a null id is kept; other columns are
ignored."""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from keelson.llm.common import bounded_batches, free_name, stored
from keelson.registry import query

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB = 20  # bits of a factor: a block's products stay exact in doubles
BLOCK = 4096  # vectors multiplied at a time
WORD = 40  # bits of the words that sums travel in
ROOT_BITS, WORK_BITS = 200, 480  # binary digits of a root; fixed-point digits of the elimination


def integers(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of a column of float lists: which rows are usable, and for each length their places and floor(SCALE * c)."""
    size = np.where(np.asarray(column.is_valid()), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = column.flatten()
    values = np.floor(SCALE * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore"):
        good = np.abs(values) < 2.0**62
    begin = np.cumsum(size) - size
    bad = np.r_[0, np.cumsum(~good)]
    usable = (size > 0) & (bad[begin + size] == bad[begin])
    by_size = {}
    for d in np.unique(size[usable]).tolist():
        at = np.flatnonzero(usable & (size == d))
        by_size[d] = at, values[begin[at][:, None] + np.arange(d)].astype(np.int64)
    return usable, by_size


def gram(x: np.ndarray) -> np.ndarray:
    """x'x as Python integers; products are taken limb by limb, so that doubles hold them exactly."""
    limbs, rest = [], x
    while True:
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)  # signed, so small entries have one limb
        limbs.append(low.astype(float))
        rest = (rest - low) >> LIMB
        if not rest.any():
            break
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of this task's vectors: the number, sums and upper triangle of products, in three words each."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, (_, x) in integers(batch.column(0))[1].items():
            own = total.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            for low in range(0, len(x), BLOCK):
                part = x[low : low + BLOCK]
                own[0] += len(part)
                own[1] += part.astype(object).sum(axis=0) if np.abs(part).max() >= 1 << 50 else part.sum(axis=0).astype(object)
                own[2] += gram(part)
    for d, (n, s, g) in total.items():
        flat = [n, *s, *g[np.triu_indices(d)]]
        mask = (1 << WORD) - 1
        words = [pa.array([int(v) & mask for v in flat]), pa.array([int(v) >> WORD & mask for v in flat]), pa.array([int(v) >> 2 * WORD for v in flat])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), *words], names=["d", "place", "a", "b", "c"])


def scatter(vectors: DataFrame, column: str) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of the integer vectors (without SHIFT) and the scatter matrix n * X'X - SS', exact.

    What reaches the driver is one number for each pair of dimensions."""
    parts = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(_sums, "d int, place int, a bigint, b bigint, c bigint")
    # words are below 2**WORD, so a sum of millions of tasks is a long
    rows = parts.groupBy("d", "place").agg(*[F.sum(x).alias(x) for x in "abc"])
    rows = stored(rows)
    counts = rows.where("place = 0").select("d", "a", "b").collect()  # one row for each length that occurs
    if not counts:
        return 0, [], []
    d = max(counts, key=lambda r: (r["a"] + (r["b"] << WORD), r["d"]))["d"]
    flat = {r["place"]: r["a"] + (r["b"] << WORD) + (r["c"] << 2 * WORD) for r in rows.where(F.col("d") == d).toLocalIterator()}
    n, s = flat[0], [flat[1 + i] for i in range(d)]
    matrix = [[0] * d for _ in range(d)]
    for place, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        matrix[i][j] = matrix[j][i] = n * flat[1 + d + place] - s[i] * s[j]
    return n, s, matrix


# the characteristic polynomial

def primes(count: int) -> list[int]:
    """The largest primes below 2**31; products of two residues fit a long."""
    out, x = [], (1 << 31) - 1
    while len(out) < count:
        if all(pow(a, x - 1, x) == 1 for a in (2, 3)) and _strong(x):
            out.append(x)
        x -= 2
    return out


def _strong(x: int) -> bool:
    """Miller-Rabin with bases that are certain below 3 * 10**9."""
    odd, twos = x - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        y = pow(a, odd, x)
        if y in (1, x - 1):
            continue
        for _ in range(twos - 1):
            y = y * y % x
            if y == x - 1:
                break
        else:
            return False
    return True


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo p, from x**0 on: reduction to Hessenberg form, then its recurrence."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        # row operations and the inverse column operation keep the polynomial
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        row = np.roll(poly[k - 1], 1)
        row = (row - h[k - 1, k - 1] * poly[k - 1] % p) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            row = (row - int(h[i - 1, k - 1]) * product % p * poly[i - 1] % p) % p
        poly[k] = row
    return poly[d].tolist()


def _spread(spark: SparkSession, rows: list, schema: str, run, out: str) -> list:
    """A bounded list of independent tasks, run on the executors."""
    given = spark.createDataFrame(rows, schema)
    return given.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, out).collect()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients from x**0 on, of a positive semidefinite matrix of integers."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # elementary symmetric functions of non-negative roots are largest if all are equal
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    used = primes((2 * bound).bit_length() // 30 + 1)
    packed = [[str(v) for v in row] for row in matrix]

    def run(batches):
        own = [[int(v) for v in row] for row in packed]
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_modulo(own, p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    residues = {r["p"]: r["c"] for r in _spread(spark, [(p,) for p in used], "p bigint", run, "p bigint, c array<bigint>")}
    return chinese_remainder(used, [residues[p] for p in used])


def chinese_remainder(used: list[int], residues: list[list[int]]) -> list[int]:
    """The integers of least absolute value with these residues."""
    whole = math.prod(used)
    basis = [whole // p * pow(whole // p, -1, p) for p in used]
    values = [sum(b * r[k] for b, r in zip(basis, residues, strict=True)) % whole for k in range(len(residues[0]))]
    return [v - whole if 2 * v > whole else v for v in values]


# roots and vectors

def roots_above(poly: list[int], at: int) -> int:
    """How many roots are greater than ``at``: the sign changes of poly(x + at), exact if all roots are real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def root_bracket(poly: list[int], number: int, top: int, bits: int = ROOT_BITS) -> tuple[int, int]:
    """(v, k): the root ``number`` (from 1, falling) lies above v / 2**k and not above (v + 1) / 2**k.

    The path of halves is the same for equal roots, so a multiple root gets one bracket."""
    # whole numbers first, which keeps the coefficients short
    low, high = -1, top
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if roots_above(poly, middle) >= number else (low, middle)
    k = max(0, bits - max(1, high).bit_length())
    d = len(poly) - 1
    fine = [c << k * (d - i) for i, c in enumerate(poly)]
    low, high = low << k, high << k
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if roots_above(fine, middle) >= number else (low, middle)
    return low, k


def null_vectors(matrix: list[list[int]], value: Fraction, count: int, bits: int = WORK_BITS) -> list[list[float]]:
    """``count`` orthogonal unit vectors of an eigenvalue, by inverse iteration in fixed-point numbers."""
    d = len(matrix)
    down = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    one = 1 << bits
    shifted = value * (Fraction(one) / (1 << down))
    own = round(shifted)
    a = [[(v << bits) >> down for v in row] for row in matrix]
    for i in range(d):
        a[i][i] -= own
    swap = list(range(d))
    for m in range(d):
        pivot = max(range(m, d), key=lambda i: abs(a[i][m]))
        a[m], a[pivot] = a[pivot], a[m]
        swap[m], swap[pivot] = swap[pivot], swap[m]
        a[m][m] = a[m][m] or 1  # an exact root: one unit in the last place
        head = a[m]
        for row in a[m + 1 :]:
            f = row[m] = (row[m] << bits) // head[m]
            if f:
                for j in range(m + 1, d):
                    row[j] -= f * head[j] >> bits

    def solve(b: list[int]) -> list[int]:
        y = [b[i] for i in swap]
        for i in range(d):
            y[i] -= sum(a[i][j] * y[j] for j in range(i)) >> bits
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] << bits) - sum(a[i][j] * y[j] for j in range(i + 1, d))) // a[i][i]
        return y

    def unit(v: list[int]) -> list[int]:
        norm = math.isqrt(sum(x * x for x in v)) or 1
        return [(x << bits) // norm for x in v]

    found: list[list[int]] = []
    draw = np.random.default_rng(d)
    for _ in range(count):
        v = unit([int(x) for x in draw.integers(-(1 << 30), 1 << 30, d)])
        for _ in range(3):
            for u in found:
                share = sum(x * y for x, y in zip(u, v, strict=True)) >> bits
                v = [y - (share * x >> bits) for x, y in zip(u, v, strict=True)]
            v = unit(solve(v))
        for _ in range(2):
            for u in found:
                share = sum(x * y for x, y in zip(u, v, strict=True)) >> bits
                v = [y - (share * x >> bits) for x, y in zip(u, v, strict=True)]
            v = unit(v)
        found.append(v)
    return [[float(Fraction(x, one)) for x in v] for v in found]


def principal_components(spark: SparkSession, matrix: list[list[int]], count: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit vector) of the largest positive eigenvalues, falling."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if trace <= 0:
        return []
    poly = characteristic_polynomial(spark, matrix)
    rank = roots_above(poly, 0)
    words, packed = [str(c) for c in poly], [[str(v) for v in row] for row in matrix]

    def isolate(batches):
        own = [int(c) for c in words]
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            found = [root_bracket(own, i, trace) for i in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([str(v) for v, _ in found]), pa.array([k for _, k in found], pa.int32())], names=["number", "v", "k"])

    wanted = min(count, rank)
    brackets = sorted(_spread(spark, [(i,) for i in range(1, wanted + 1)], "number int", isolate, "number int, v string, k int"))
    roots: dict[tuple[str, int], int] = {}
    for r in brackets:
        roots[r["v"], r["k"]] = roots.get((r["v"], r["k"]), 0) + 1

    def middle(v: str, k: int) -> Fraction:
        return Fraction(2 * int(v) + 1, 2 << k)

    def iterate(batches):
        own = [[int(v) for v in row] for row in packed]
        for batch in batches:
            first, v, k, n = (x.to_pylist() for x in batch.columns)
            made = [null_vectors(own, middle(b, c), m) for b, c, m in zip(v, k, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(made, pa.list_(pa.list_(pa.float64())))], names=["first", "vectors"])

    jobs, first = [], 1
    for (v, k), n in roots.items():
        jobs.append((first, v, k, n))
        first += n
    done = {r["first"]: r["vectors"] for r in _spread(spark, jobs, "first int, v string, k int, n int", iterate, "first int, vectors array<array<double>>")}
    return [(middle(v, k), vector) for f, v, k, _ in jobs for vector in done[f]]


def root_of(value: Fraction) -> float:
    """Square root of a fraction as the nearest double."""
    with decimal.localcontext(prec=60):
        return float((decimal.Decimal(value.numerator) / decimal.Decimal(value.denominator)).sqrt())


def project(vectors: DataFrame, column: str, n: int, sums: list[int], components: list[tuple[Fraction, list[float]]]) -> DataFrame:
    """The usable vectors with ``deviation`` (decimal) and ``whitened`` (array); other columns are kept."""
    bounded_batches(vectors.sparkSession, 4096)
    name, = free_name(vectors, "_v")
    keep, d = [x for x in vectors.columns if x.lower() not in (column.lower(), "deviation", "whitened")], len(sums)
    axes = np.array([v for _, v in components]).T / np.array([root_of(e) for e, _ in components])
    texts = [str(s) for s in sums]
    fed = vectors.select(*[F.col(f"`{x}`") for x in keep], F.col(column).cast("array<double>").alias(name))
    schema = StructType([*fed.schema.fields[:-1], StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    names = schema.names

    def run(batches):
        s = np.array([int(x) for x in texts], object)
        for batch in batches:
            at, x = integers(batch.column(len(keep)))[1].get(d, (np.zeros(0, np.int64), None))
            if not len(at):
                continue
            if max(int(np.abs(x).max()) * n, max(abs(int(v)) for v in s)) < 1 << 62:
                centred = n * x - s.astype(np.int64)
            else:
                centred = n * x.astype(object) - s
            if centred.dtype == object or int(np.abs(centred).max()) ** 2 * d >= 1 << 63:
                deviation = [int(v) for v in (centred.astype(object) ** 2).sum(axis=1)]
            else:
                deviation = (centred**2).sum(axis=1).tolist()
            # n * x - s is n times the centred vector, the square root of an eigenvalue n times the deviation along it
            white = centred.astype(float) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(len(keep))], pa.array([decimal.Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)), lists], names=names)

    return fed.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity; the aggregate centres before it multiplies."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    values = whitened.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(components)])
    row = values.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


WHITE = "n bigint, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: the other columns with n, deviation, component, whitened, explained and identity_error."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors, column)
    components = principal_components(spark, matrix, count) if matrix else []
    keep = [x for x in vectors.columns if x.lower() not in (column.lower(), "n", "deviation", "component", "whitened", "explained", "identity_error")]
    if not components:
        none = StructType([*vectors.select(*keep).schema.fields, *spark.createDataFrame([], WHITE).schema.fields])
        return spark.createDataFrame([], none)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    white = stored(project(vectors.select(*keep, column), column, n, sums, components))
    error = identity_error(white, len(components))
    explained = F.array(*[F.lit(float(e / trace)) for e, _ in components])
    each = white.select(*keep, "deviation", F.posexplode("whitened").alias("_place", "_value"))
    return each.select(
        *keep, F.lit(n).cast("bigint").alias("n"), "deviation", (F.col("_place") + 1).alias("component"), F.col("_value").alias("whitened"),
        F.get(explained, F.col("_place")).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op12_exact_whitening")
def op12_exact_whitening(t):
    out = whiten(t.embeddings.select("vec_id", "embedding"))
    # a long, as long as it fits one
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
