import numpy as np
import pytest

from candleflow.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, mult int"


def brute(rows, t=0.93):
    root = {i: i for i in range(len(rows))}
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(v):
        if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)
    units = [unit(r[1]) for r in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None \
                    and rows[i][2] == rows[j][2] and a @ b >= t:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    comp = {}
    for i in range(len(rows)):
        comp.setdefault(find(i), []).append(rows[i][0])
    return [(r[0], links[i], min(comp[find(i)])) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [7, 1000])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    centre = rng.standard_normal(48)
    for i in range(150):
        label = i % 3
        if i % 3 == 0 and i < 90:  # a crowd of near copies in one label
            v = centre + rng.standard_normal(48) * 0.2
        elif i % 7 == 1:
            v = np.array(rows[-3][1]) + rng.standard_normal(48) * 0.3 if len(rows) > 3 else centre
        else:
            v = rng.standard_normal(48)
        rows.append((i + 10, [float(np.float32(x)) for x in v], label))
    rows += [(500, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]),
             (501, [2 * x for x in rows[6][1]], rows[6][2]), (502, rows[6][1], None), (503, None, 1), (504, [], 1),
             (505, [0.0] * 48, 1), (506, [float("nan")] + [1.0] * 47, 1), (507, [None] + [1.0] * 47, 1),
             (508, [float("inf")] + [1.0] * 47, 1), (509, [1.0, 2.0], 1), (510, [1.0, 2.0], 1),
             (511, [3e38] * 48, 2), (512, [1e-38] * 48, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((r["id"], r["n_links"], r["component"]) for r in E.link_embeddings(df, block=block).collect())
    assert got == sorted(brute(rows))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.standard_normal((1500, 64))
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c = 0.9301
    y = c * x + np.sqrt(1 - c * c) * n  # every pair just above the threshold
    links = E.collision_pairs(x, y, False, 0.93)
    assert np.diag(links).mean() >= 0.995
    exact = x @ y.T >= 0.93
    assert not (links & ~exact).any()


def test_empty(spark):
    assert E.link_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
