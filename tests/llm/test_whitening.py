import numpy as np
import pytest

from strandloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, component string, n long"


def vectors(n=300, d=40, seed=13):
    """Vectors with a falling spectrum, one of them two hundred times, and rows that cannot be used."""
    r = np.random.default_rng(seed)
    v = (r.standard_normal((n, d)) * np.geomspace(2, 0.05, d) + 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    inf, nan = float("inf"), float("nan")
    rows += [(2000, None), (2001, [None, *rows[0][1][1:]]), (2002, [inf, *rows[0][1][1:]]), (2003, [nan, *rows[0][1][1:]]), (2004, []), (2005, [1.0]), (None, rows[1][1]), (5, rows[5][1]), (2006, [3e38, *rows[0][1][1:]])]
    return [(i, x, None, 1, "a", None, 3) for i, x in rows]


def brute(rows, d):
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and abs(c) < 1e30 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, u = np.linalg.eigh(c.T @ c / n)
    return kept, n, s, values[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [3, 40, 150])
def test_whitened_rows_match_a_dense_solver(spark, d):
    rows = vectors(d=d)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    kept, n, s, values, u = brute(rows, d)
    k = min(16, d)
    assert len(got) == len(kept) * k and n == 300
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), set()).add((r["n"], r["deviation"], r["whitened"]))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    signs = np.zeros(k)
    for i, x in kept:
        for j in range(k):
            [(m, deviation, white)] = by[i, j + 1]
            wanted = float((x - s / n) @ u[:, j] / np.sqrt(values[j]))
            signs[j] = signs[j] or np.sign(white * wanted)
            assert m == n and deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)) and white == pytest.approx(signs[j] * wanted, abs=1e-7)


def test_products_alone_give_eigenpairs_of_close_values():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.standard_normal((400, 400)))
    true = np.sort(np.concatenate([np.linspace(1, 0.9, 30), r.random(370) * 0.85]))[::-1]
    matrix = (q * true) @ q.T
    widths = []
    values, vectors, residuals = whitening.leading(lambda b: (widths.append(b.shape[1]), matrix @ b)[1], 400, 16)
    assert np.allclose(values, true[:16], atol=1e-12) and max(residuals) < 1e-12 and max(widths) <= 72 and len(widths) < 200
    assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)


def test_deviation_is_exact_or_null_where_a_long_ends():
    x = np.array([[5, 2**40], [2**61, 7], [5, 6]])
    n, s = 10**7, np.array([5 * 10**7 + 3, 6 * 10**7 + 1])
    wanted = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert whitening.Centre(n, s).deviation(x) == [w if w < 2**63 else None for w in wanted] and wanted[2] < 2**63 < wanted[1]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]], ids=["none", "null", "one", "equal"])
def test_tables_without_a_spread_give_no_rows(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_fewer_directions_than_components_give_as_many_as_there_are(spark):
    rows = [(i, [float(i % 7), float(2 * (i % 7)), float(i % 3), 1.0]) for i in range(60)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 120 and sum({r["explained"] for r in got}) == pytest.approx(1)
