import numpy as np

from candleflow.llm import whitening as W
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], q[:, ::-1]


def compare(rows, ids, vectors, k=8, tol=1e-8):
    x, n, s, e, q = expected(vectors)
    k = min(k, len(e))
    assert len(rows) == n * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(1, k + 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        want = (x - s / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        sign = np.sign(mine @ want)
        assert np.abs(mine - sign * want).max() < tol, c
        assert abs(got[ids[0], c]["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-10
    for i, row in zip(ids, x.tolist()):
        assert got[i, 1]["deviation"] == sum((n * a - int(b)) ** 2 for a, b in zip(row, s))
        assert got[i, 1]["n"] == n
    assert rows[0]["identity_error"] < 1e-9


def test_table(spark):
    from candleflow.llm.queries import QUERIES

    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    compare(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def query(df):
    return W.by_component(W.whiten(df)).withColumnRenamed("id", "vec_id").collect()


def test_fewer_steps_than_dimensions(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((400, 96)) * 0.5 ** np.arange(96)).astype(np.float32) * 20
    rows = W.Rows(W.quantised(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)))
    found = W.bidiagonalise(rows)
    assert found.steps < 40
    _, _, _, e, q = expected(vectors)
    assert np.allclose(found.variances, e[:8], rtol=1e-11)
    assert np.allclose(np.abs((found.directions * q[:, :8]).sum(0)), 1, atol=1e-10)


def test_unusable_rows_and_few_dimensions(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = rng.standard_normal((30, 3)).astype(np.float32).tolist()
    good[7] = good[3]  # a repeated vector
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(good + bad)], SCHEMA)
    from pyspark.sql import functions as F
    df = df.withColumns({c: F.lit("x") for c in ("id", "x", "n", "component", "whitened")})
    compare(query(df), list(range(30)), good, tol=1e-10)


def test_repeated_eigenvalues(spark):
    corners = [(a, b, c, 0.0) for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    rows = query(spark.createDataFrame([(i, list(v), 0) for i, v in enumerate(corners)], SCHEMA))
    assert {r["component"] for r in rows} == {1, 2, 3}  # the fourth direction has no variance
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 for r in rows) and rows[0]["identity_error"] < 1e-12


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((5, 20)).astype(np.float32).tolist()
    rows = query(spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], SCHEMA))
    assert len(rows) == 5 * 4 and rows[0]["identity_error"] < 1e-9
    assert abs(sum(r["explained"] for r in rows if r["vec_id"] == 0) - 1) < 1e-12


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(4)], [(1, None, 0)]):
        assert query(spark.createDataFrame(rows, SCHEMA)) == []
