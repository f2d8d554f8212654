import math

import numpy as np
import pytest

from queryscore.llm import whitening
from queryscore.llm.whitening import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["spread", "equal", "zero", "graded"])
def test_rank_one_update_equals_a_full_decomposition(kind):
    rng = np.random.default_rng(3)
    for size in range(1, 24):
        values = {
            "spread": np.sort(rng.normal(size=size) ** 2), "equal": np.sort(rng.integers(0, 3, size).astype(float)),
            "zero": np.zeros(size), "graded": np.sort(10.0 ** rng.uniform(-15, 3, size)),
        }[kind]
        vectors, _ = np.linalg.qr(rng.normal(size=(size, size)))
        v, rho = rng.normal(size=size) * (rng.random(size) < 0.7), 10.0 ** rng.uniform(-3, 3)
        whole = vectors @ np.diag(values) @ vectors.T + rho * np.outer(v, v)
        new, basis = rank_one(values, vectors, v, rho)
        assert (np.diff(new) >= 0).all()
        assert np.abs(basis.T @ basis - np.eye(size)).max() < 1e-13
        assert np.abs(basis @ np.diag(new) @ basis.T - whole).max() <= 1e-13 * max(np.abs(whole).max(), 1e-300)


def test_spectra_grow_and_merge():
    x = np.floor(64 * np.random.default_rng(4).normal(size=(500, 12)))
    x[:, 3] = 7
    x[:, 5] = x[:, 6]
    whole, one, two = Spectrum.empty(12), Spectrum.empty(12), Spectrum.empty(12)
    for row in x:
        whole.add(row)
    for row in x[:100]:
        one.add(row)
    for row in x[100:]:
        two.add(row)
    one.merge(two)
    scatter = np.cov(x.T, bias=True) * len(x)
    for found in (whole, one):
        assert found.n == 500 and found.mean == pytest.approx(x.mean(0))
        assert found.vectors @ np.diag(found.values) @ found.vectors.T == pytest.approx(scatter, abs=1e-7)


def _plain(rows):
    """Contract by brute force: (n, e, v, mean) of the distinct grid vectors, and the grid vectors by id."""
    grid = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vec) for i, vec in rows}
    x = np.array(sorted(set(grid.values())), float)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    return len(x), e[::-1], v[:, ::-1], x.mean(0), grid


def _rows(n=900, dim=20, seed=5):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)) @ np.diag(np.linspace(0.05, 2, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 3
    return [(i, [float(c) for c in row]) for i, row in enumerate(data.astype(np.float32))]


def test_components_equal_brute_force(spark):
    rows = _rows()
    rows += [(5000 + i, rows[7][1]) for i in range(400)] + [(7, rows[7][1])]
    bad = [(9000, None), (9001, [None] * 20), (9002, [float("nan")] * 20), (9003, [1.0] * 19 + [float("inf")]), (9004, []), (9005, [1.0]), (9006, [3e38] * 20)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).repartition(6)
    n, e, v, mean, grid = _plain(rows)
    whole = np.array([grid[i] for i, _ in rows])
    sums = np.array(sorted(set(grid.values()))).sum(0)
    model = whitening.fit(table, task_vectors=40)
    assert model.n == n and model.sums == tuple(map(int, sums))
    assert model.variances == pytest.approx(e, rel=1e-10) and model.identity_error < 1e-9
    assert np.abs(np.abs((model.directions * v).sum(0)) - 1).max() < 1e-9
    found = whitening.components_of(table, carry=["vec_id"]).collect()
    assert len(found) == 16 * len(rows) and {r.vec_id for r in found} == {i for i, _ in rows}
    sign = np.sign((model.directions * v).sum(0))
    white = {i: (np.array(grid[i]) - mean) @ v / np.sqrt(e) for i, _ in rows}
    signs = {}
    for r in found:
        assert r.n == n and r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(grid[r.vec_id], sums))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * want))
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
    assert all(len(s) == 1 for s in signs.values()) and whole.shape == (len(rows), 20) and len(sign) == 20


def test_few_dimensions_constant_entries_and_single_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    found = whitening.components_of(frame([(1, [0.0, 1.0, 5.0]), (2, [1.0, 1.0, 5.0]), (3, [2.0, 1.0, 5.0])]), carry=["vec_id"]).collect()
    assert [(r.component, r.explained) for r in found] == [(1, pytest.approx(1.0))] * 3
    assert sorted(abs(r.whitened) for r in found) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        empty = whitening.components_of(frame(rows), carry=["vec_id"])
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.fit(frame([(1, None)])) is None


def test_clashing_columns_and_large_entries(spark):
    rows = [(1, [0.0, 1.0], 5, 6), (2, [1.0, 2.0], 7, 8), (3, [3.0, 1.5], 9, 10)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x int")
    found = whitening.components_of(clash).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.x) for r in found] == [(i, k, x) for i, _, _, x in rows for k in (1, 2)]
    huge = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(huge)
    assert model.sums == (3_000_000, 3_000_000 + 256)
    assert {r.deviation for r in whitening.whiten(huge, model).collect() if r.vec_id < 3} == {None}
