"""Whitening of embeddings by polarised covariances (operator 11)."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.llm.common import written

#: An entry c becomes the integer floor(GRID * c) + OFFSET.
GRID, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries beyond this have no long; their vectors are dropped like those with infinite entries.
LARGEST = 2.0**62
#: Sums travel in two decimals, total = high * LIMB + low.
LIMB = 2**64


def usable(vector: Column) -> Column:
    """The vector has entries, all of them finite numbers whose scaled value fits a long."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * GRID) < LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, good), F.lit(False))


def grid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the remaining vectors as integers on the grid.

    All have one length, the most frequent one (the larger of equally frequent ones); vectors of another length are
    dropped with the unusable ones.
    """
    rows = embeddings.select("vec_id", "embedding").where(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if sizes is None:
        return rows.select("vec_id", F.array().cast("array<long>").alias("x"))
    x = F.transform("embedding", lambda c: (F.floor(c.cast("double") * GRID).cast("long") + OFFSET))
    return rows.where(F.size("embedding") == sizes["d"]).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return np.asarray(lists.flatten()).reshape(batch.num_rows, -1)


def _exact(rows: np.ndarray, largest: int) -> np.ndarray:
    """Integers as 64-bit numbers where sums of their squares over the rows fit, else as Python integers."""
    return rows if len(rows) * (2 * largest) ** 2 < 2**63 else rows.astype(object)


def _limbs(totals: list[tuple]) -> pa.RecordBatch:
    """(i, j, sum of squares, sum) rows with their totals split into two decimals."""
    from decimal import Decimal

    kind = pa.decimal128(38, 0)
    columns = [pa.array([t[k] for t in totals], pa.int32()) for k in range(2)]
    for k in (2, 3):
        parts = [divmod(t[k], LIMB) for t in totals]
        columns += [pa.array([Decimal(p[side]) for p in parts], kind) for side in range(2)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "q1", "q0", "s1", "s0"])


def polarised_sums(vectors: DataFrame, centre: list[int]) -> DataFrame:
    """(i, j, ...) rows: over all vectors, sums and sums of squares of the centred value of dimension i (i = j), and of
    the sum of the centred values of dimensions i and j (i < j).

    Each task keeps one total per pair, exact whatever the size of the entries, and sends these alone.
    """
    d = len(centre)
    middle = np.array(centre, dtype=np.int64)

    def run(batches):
        squares = [[0] * d for _ in range(d)]
        sums = [0] * d
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _matrix(part)
                z = x - middle  # fits: entries are below 2^62 and so is their mean
                z = _exact(z, int(np.abs(z).max()))
                for i in range(d):
                    pair = z[:, i:] + z[:, i : i + 1]
                    pair[:, 0] = z[:, i]
                    for j, q in enumerate((pair * pair).sum(axis=0), i):
                        squares[i][j] += int(q)
                for i, s in enumerate(z.sum(axis=0)):
                    sums[i] += int(s)
        yield _limbs([(i, j, squares[i][j], sums[i] + (sums[j] if j > i else 0)) for i in range(d) for j in range(i, d)])

    kinds = "i int, j int, q1 decimal(38,0), q0 decimal(38,0), s1 decimal(38,0), s0 decimal(38,0)"
    made = vectors.select("x").mapInArrow(run, kinds)
    return made.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("q1", "q0", "s1", "s0")])


@dataclass
class Whitening:
    """Fitted components: `vectors` are columns by falling eigenvalue of the covariance of x."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def kept(self) -> int:
        return min(COMPONENTS, len(self.sums))

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the kept components; nan for those without variance beyond rounding."""
        e = self.values[: self.kept]
        some = e > max(self.trace, 0.0) * 1e-13
        return np.where(some, 1 / np.sqrt(np.where(some, e, 1.0)), np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (((x - whole) - rest) @ self.vectors[:, : self.kept]) * self.scale


def fit(vectors: DataFrame) -> Whitening | None:
    """Covariance of the grid vectors (divisor n) and its eigenvectors; None without vectors.

    The exact sums per dimension and per pair come from Spark.  With squares centred at the mean, the variance of a
    sum of two dimensions less both variances is twice their covariance; rational arithmetic keeps every entry of the
    matrix exact until it is rounded to a double.  What reaches the driver grows with the squared dimension only.
    """
    first = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")
    ).orderBy("i").collect()
    if not first:
        return None
    n, sums = first[0]["n"], [int(r["s"]) for r in first]
    d = len(sums)
    centre = [s // n for s in sums]
    variance = {}
    for r in polarised_sums(vectors, centre).collect():
        square, total = (int(r[f"{c}1"]) * LIMB + int(r[f"{c}0"]) for c in "qs")
        # Sum of (n * z - total)^2, z being centred at the whole part of the mean, divided by n^3.
        variance[r["i"], r["j"]] = Fraction(n * square - total * total, n * n)
    cov = np.empty((d, d))
    for i in range(d):
        cov[i, i] = variance[i, i]
        for j in range(i + 1, d):
            cov[i, j] = cov[j, i] = (variance[i, j] - variance[i, i] - variance[j, j]) / 2
    values, basis = np.linalg.eigh(cov)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), basis[:, ::-1].copy(), float(sum(variance[i, i] for i in range(d))))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    live = np.isfinite(fitted.scale)
    k = int(live.sum())
    if not k:
        return 0.0

    def run(batches):
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = fitted.project(_matrix(batch))[:, live]
            products += w.T @ w
            sums += w.sum(axis=0)
        own = {"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "p": products.ravel(), "s": np.repeat(sums, k)}
        yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in own.items()})

    made = vectors.select("x").mapInArrow(run, "i long, j long, p double, s double")
    got = made.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).orderBy("i", "j").collect()
    products = np.array([r["p"] for r in got]).reshape(k, k) / fitted.n
    means = np.array([r["s"] for r in got]).reshape(k, k)[:, 0] / fitted.n
    return float(np.abs(products - np.outer(means, means) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame) -> DataFrame:
    """One row per remaining vector and component (at most COMPONENTS): `WHITENED`.

    Vectors that are null, empty, hold null or non-finite entries, or have another length than the most frequent one,
    are dropped.  `deviation` is exact, and null where it exceeds a long.  A component without variance (repeated
    rows only, or more components than independent vectors) has a null value; `explained` is null where nothing
    varies.  Repeated rows and ids count as rows of their own; null ids stay.  Other columns are ignored; of equal
    eigenvalues any basis may come.  Empty in, empty out.
    """
    vectors = written(grid_vectors(embeddings), "vectors")
    fitted = fit(vectors)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(vectors, fitted)
    k, n = fitted.kept, fitted.n
    whole = np.array([s // n for s in fitted.sums], dtype=np.int64)
    rest = np.array([s % n for s in fitted.sums], dtype=np.int64)
    rest_squared = sum(int(r) ** 2 for r in rest)
    share = fitted.values[:k] / fitted.trace if fitted.trace > 0 else np.full(k, np.nan)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _matrix(part)
                z = x - whole
                # Sum of (n * z - rest)^2, the sums over dimensions in 64 bits where they fit, the rest in Python integers.
                largest = int(np.abs(z).max()) + 1
                z = z if x.shape[1] * largest * max(largest, n) < 2**63 else z.astype(object)
                squares, products = (z * z).sum(axis=1).astype(object), (z * rest).sum(axis=1).astype(object)
                away = squares * (n * n) - products * (2 * n) + rest_squared
                away = pa.array([v if v < 2**63 else None for v in away], pa.int64())
                at = pa.array(np.repeat(np.arange(part.num_rows), k))
                w = fitted.project(x).ravel()
                columns = [
                    part.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(len(w), n, dtype=np.int64)),
                    away.take(at),
                    pa.array(w, mask=~np.isfinite(w)),
                    pa.array(np.tile(share, part.num_rows), mask=np.tile(~np.isfinite(share), part.num_rows)),
                    pa.array(np.full(len(w), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WHITENED.split(", ")])

    return vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, WHITENED)
