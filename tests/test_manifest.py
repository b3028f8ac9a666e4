"""Feature manifest: the Spark-side hash equals sha256 of Python's JSON list
(", " separators), first 16 hex digits; the diff lists missing/extra."""

import hashlib
import json

from candleflow.operators import features as FT


def test_manifest_hash_matches_python(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "b_col int, a_col double, c_col string")
    row = FT.manifest(df).first()
    cols = sorted(df.columns)
    assert row.columns_json == json.dumps(cols)
    assert row.column_hash == hashlib.sha256(json.dumps(cols).encode()).hexdigest()[:16]
    assert row.row_count == 1 and row.n_columns == 3
    assert FT.manifest_hash_py(df.columns) == row.column_hash


def test_manifest_diff(spark):
    a = FT.manifest(spark.createDataFrame([(1, 2)], "x int, y int"))
    b = FT.manifest(spark.createDataFrame([(1, 2), (3, 4)], "y int, z int"))
    got = {(r.column, r.status, r.row_count) for r in FT.manifest_diff(a, b).collect()}
    assert got == {("x", "missing", 1), ("z", "extra", 2)}


def test_store_tail_and_versions(spark, tmp_path):
    import datetime as dt

    from candleflow.sources.store import TableStore
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for s in ("A", "B") for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, ts date, v double")
    assert store.save("preds", df) == 1
    tail = store.load_tail("preds", 30)
    assert tail.count() == 60 and tail.agg({"v": "min"}).first()[0] == 20.0
    new = spark.createDataFrame([("A", dt.date(2020, 1, 1), -1.0)], "symbol string, ts date, v double")
    out = store.upsert("preds", new, ["symbol", "ts"])
    assert out.count() == 100 and store._versions("preds") == [1, 2]
    assert out.filter("symbol = 'A' AND ts = DATE'2020-01-01'").first()["v"] == -1.0


def test_a_failed_write_is_never_the_current_version(spark, tmp_path):
    import os

    from candleflow.sources.store import TableStore
    store = TableStore(spark, str(tmp_path / "store"))
    store.save("t", spark.range(3))
    os.makedirs(tmp_path / "store" / "t" / "v=2")  # no _SUCCESS: the write did not finish
    assert store.load("t").count() == 3
    assert store.save("t", spark.range(5)) == 3 and store.load("t").count() == 5
