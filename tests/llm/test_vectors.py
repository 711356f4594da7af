"""Whitening and near vectors against plain versions, on the small tables and on awkward rows."""

import os
import sys
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from creaseline.llm import lattice, whitening  # noqa: E402
from creaseline.llm.queries import QUERIES  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, n long, kept boolean, x string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 7, False, "y") for i, v in vectors], SCHEMA).repartition(3)


def vectors_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return [(r["vec_id"], r["embedding"]) for r in rows]


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return vectors_of(spark, sf_dir)


def check_whitened(out, rows):
    """Against integers of any size and a plain eigenvalue solution."""
    x = {i: [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for i, v in rows}
    n, d = len(x), len(next(iter(x.values())))
    k = min(32, d)
    table = np.array(list(x.values()), dtype=np.int64)
    sums = table.sum(axis=0)
    centred = table - sums / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    assert len(out) == n * k
    made = np.full((n, k), np.nan)
    index = {i: a for a, i in enumerate(x)}
    for r in out:
        exact = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[r["vec_id"]], sums))
        assert (r["n"], r["deviation"]) == (n, exact if exact < 2**63 else None)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6, abs=1e-12)
        assert r["identity_error"] <= 1e-6
        made[index[r["vec_id"]], r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
    live = ~np.isnan(made).any(axis=0)
    assert live.sum() == min(k, (values > values.sum() * 1e-12).sum())
    made = made[:, live]
    assert np.abs(made.T @ made / n - np.eye(live.sum())).max() < 1e-6
    # Projections on an eigenvector: the covariance maps them to themselves.
    basis = centred.T @ made / n
    cov = centred.T @ centred / n
    assert np.allclose(cov @ basis, basis * values[: made.shape[1]], atol=1e-6 * values[0])


def test_whitening_of_the_table(spark, sf_dir, given):
    check_whitened(QUERIES["op11_whitening"](spark, sf_dir).collect(), given)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [1, 9, 0.3, 1e3, 0]]) for i in range(40)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [1.0, float("nan"), 2.0, 3.0, 4.0]), (94, [float("inf")] * 5), (95, [1.0, 2.0]), (96, [1e30] * 5)]
    check_whitened(whitening.whitened(frame(spark, good + bad)).collect(), good)
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, bad[:2])).columns == [f.split()[0] for f in whitening.WHITENED.split(", ")]
    same = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(3, 0, None, None)] * 6


def test_polarised_sums_stay_exact_for_large_entries(spark):
    big = [(i, [float(s) * 2.0**50, 1.0 * i]) for i, s in enumerate([1, -1, 1, -3])]
    x = [[int(v[0]) * 64 + 1_000_000, int(v[1]) * 64 + 1_000_000] for _, v in big]
    fitted = whitening.fit(whitening.grid_vectors(frame(spark, big)))
    mean = [Fraction(sum(c), 4) for c in zip(*x)]
    trace = sum(Fraction(1, 4) * sum((r[k] - mean[k]) ** 2 for r in x) for k in range(2))
    assert fitted.sums == [sum(c) for c in zip(*x)]
    assert fitted.trace == float(trace)


def linked(rows, threshold=0.9):
    """vec_id -> (links, component) by comparing all pairs."""
    ids = [i for i, _ in rows]
    units = np.array([v for _, v in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= threshold
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b]
    component = brute.smallest(pairs, ids)
    return {i: (int(near[a].sum()) - 1, component[i]) for a, i in enumerate(ids)}


def test_near_vectors_of_the_table(spark, sf_dir, given):
    own = linked(given)
    out = QUERIES["op13_near_vectors"](spark, sf_dir).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == own
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out) and len(out) == len(given)


def test_large_groups_of_near_and_equal_vectors(spark, monkeypatch):
    """Blocks of a cell: every pair of a group is counted once, whatever the cells that the pair shares."""
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    centre, other = rng.normal(size=(2, 24))
    rows = [(i, centre + rng.normal(size=24) * 0.02) for i in range(300)]
    rows += [(1000 + i, other) for i in range(200)] + [(2000 + i, rng.normal(size=24)) for i in range(100)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    out = lattice.near_vectors(frame(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == linked(rows)


def test_recall_at_the_threshold(spark):
    """Pairs made with cosines of 0.9 to 0.93, nearly all others far apart."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        a, g = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        g -= a * (a @ g)
        c = rng.uniform(0.9001, 0.93)
        rows += [(2 * i, list(a)), (2 * i + 1, list(c * a + np.sqrt(1 - c * c) * g / np.linalg.norm(g)))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    own = linked(rows)
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(frame(spark, rows)).collect()}
    assert all(out[i][0] <= own[i][0] for i in own)  # none below the threshold
    assert sum(n for n, _ in out.values()) >= 0.98 * sum(n for n, _ in own.values())


def test_near_vectors_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (None, [3.0, 0.1, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 0.0, 1e-30]),
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [1.0, None, 0.0]), (None, [0.0, -1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0, 0.0]), (12, [3e38, 3e38, 3e38]),
    ]
    out = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in lattice.near_vectors(frame(spark, rows)).collect()))
    assert out == sorted(
        [(5, 2, 4, False), (4, 2, 4, True), (0, 2, 4, False), (9, 1, 9, True), (9, 1, 9, True), (9, 0, 9, True), (1, 0, 1, True), (2, 0, 2, True)]
        + [(3, 0, 3, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (0, 0, 0, True), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True)]
    )
    assert lattice.near_vectors(frame(spark, [])).count() == 0


def test_lattice_points():
    """Nearest points against all points around, and the neighbours of a point."""
    rng = np.random.default_rng(1)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)
    y = rng.normal(size=(200, 8)) * 2
    points = lattice.nearest_point(y)
    assert ((2 * points) % 1 == 0).all() and (points.sum(axis=1) % 2 == 0).all()
    around = points[:, None, :] + lattice.NEIGHBOURS[None]
    own = ((y - points) ** 2).sum(axis=1)
    assert (((y[:, None] - around) ** 2).sum(axis=2) >= own[:, None] - 1e-9).all() and own.max() <= 1 + 1e-9
