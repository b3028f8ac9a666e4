"""Panel-wide splits and folds: no training row of any series is later than a
test row of any other, minus the embargo."""

import datetime as dt

from pyspark.sql import functions as F

from candleflow.operators import dataset as D


def panel(spark, n=120):
    rows = []
    for s, first, step in (("A", 0, 1), ("B", 40, 1), ("C", 0, 3)):  # series of different spans
        for i in range(first, n, step):
            rows.append((s, dt.date(2021, 1, 1) + dt.timedelta(days=i), i % 2))
    return spark.createDataFrame(rows, "symbol string, ts date, target int")


def test_split_dates_hold_for_all_series(spark):
    out = D.chrono_split(panel(spark)).toPandas()
    last = out[out.split == "train"].ts.max()
    first = out[out.split == "test"].ts.min()
    assert (first - last).days == 11 and out[out.split == "test"].ts.nunique() == 24
    assert set(out[out.split == "embargo"].ts) == {last + dt.timedelta(days=i) for i in range(1, 11)}


def test_folds_never_train_on_later_rows(spark):
    folds = D.walk_forward_folds(panel(spark)).toPandas()
    assert sorted(folds.fold.unique()) == [0, 1, 2, 3, 4]
    for _, f in folds.groupby("fold"):
        train, test = f[f.role == "train"], f[f.role == "test"]
        assert (test.ts.min() - train.ts.max()).days == 11 and test.ts.nunique() == 20
    two = D.calibration_folds(panel(spark, 30).filter("symbol = 'A'"))
    assert two.agg(F.countDistinct("fold")).first()[0] == 2  # under 40 dates


def test_weights(spark):
    w = D.class_weights(D.sample_weights(panel(spark))).toPandas()
    assert abs((w.weight / w.class_weight).mean() - 1) < 1e-9
    assert abs(w.class_weight.sum() - len(w)) < 1e-6
    by_date = (w.weight / w.class_weight).groupby(w.ts).nunique()
    assert (by_date <= 2).all() and w.weight.notna().all()


def test_empty_panel(spark):
    none = panel(spark).limit(0)
    assert D.chrono_split(none).count() == 0 and D.walk_forward_folds(none).count() == 0
    assert D.class_weights(D.sample_weights(none)).count() == 0


def test_auc_with_a_hot_key_and_a_hot_score(spark):
    rows = [("hot", float(min(i % 97, 48)), i % 3 == 0) for i in range(4000)] + [("cold", 1.0, True), ("cold", 0.0, False)]
    df = spark.createDataFrame([(s, v, int(y)) for s, v, y in rows], "symbol string, score double, target int")
    got = {r.symbol: r.roc_auc for r in D.roc_auc(df).collect()}
    pos = [v for s, v, y in rows if s == "hot" and y]
    neg = [v for s, v, y in rows if s == "hot" and not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["hot"] - want) < 1e-12 and got["cold"] == 1.0
    assert D.roc_auc(df.filter("target = 1"), one_class=None).first().roc_auc is None
