"""Bucketed exact ranks / quantiles equal a full sort (ties included)."""

import numpy as np
import pandas as pd
import pytest

from candleflow.plans import ranking as R


@pytest.mark.parametrize("buckets", [16, 200, 4096])
def test_exact_rank_is_a_sorted_permutation(spark, buckets):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000).astype(str), "v": rng.integers(0, 300, 3000).astype(float)})
    got = R.exact_rank(spark.createDataFrame(pdf), "k", "v", buckets=buckets).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("_rank")
        assert (g["_rank"].to_numpy() == np.arange(len(g))).all()
        assert (np.diff(g["v"].to_numpy()) >= 0).all()


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 4000).astype(str), "v": rng.normal(0, 1, 4000)})
    got = R.exact_quantiles(spark.createDataFrame(pdf), "k", "v", [0.25, 0.5, 0.75]).toPandas().sort_values("k")
    exp = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.75]).unstack().sort_index()
    assert np.allclose(got[["q_0", "q_1", "q_2"]].to_numpy(), exp.to_numpy())
