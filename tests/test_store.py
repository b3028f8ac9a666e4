"""Upserts by partition: what is rewritten, replays, and two writers at once."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from candleflow.sources.store import SNAPSHOT, TableStore

SCHEMA = "symbol string, ts date, x int"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def rows(df):
    return sorted(map(tuple, df.select("symbol", "ts", "x").collect()), key=str)


@pytest.fixture()
def store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"))
    s.save("t", spark.createDataFrame([("A", day(i), i) for i in range(100)], SCHEMA))
    return s


def test_one_row_rewrites_one_partition(spark, store):
    store.upsert("t", spark.createDataFrame([("A", day(3), 300)], SCHEMA), ["symbol", "ts"])
    before = store.partitions("t")
    assert set(before) == {"2024-01", "2024-02", "2024-03", "2024-04"}
    out = store.upsert("t", spark.createDataFrame([("A", day(40), 4000), ("B", day(40), 1)], SCHEMA), ["symbol", "ts"])
    after = store.partitions("t")
    assert {k for k in after if after[k] != before[k]} == {"2024-02"}
    want = {("A", day(i)): i for i in range(100)} | {("A", day(3)): 300, ("A", day(40)): 4000, ("B", day(40)): 1}
    assert rows(out) == rows(store.load("t")) == sorted(((s, d, x) for (s, d), x in want.items()), key=str)
    # only the touched months were read for it
    files = [f for f in out.inputFiles() if after["2024-02"] in f]
    assert files and all("v=3" in f for f in files)
    assert not [f for f in out.inputFiles() if "v=1/" in f]


def test_new_columns_new_months_and_null_dates(spark, store):
    wide = spark.createDataFrame([("A", None, 7, "n"), ("Z", day(500), 8, "m")], SCHEMA + ", note string")
    out = store.upsert("t", wide, ["symbol", "ts"])
    assert out.count() == 102 and out.where("note is not null").count() == 2
    assert {"none", "2025-05"} <= set(store.partitions("t"))
    again = store.upsert("t", spark.createDataFrame([("A", None, 9)], SCHEMA), ["symbol", "ts"])
    assert again.count() == 102 and again.where("ts is null").first()["x"] == 9
    nothing = store.upsert("t", spark.createDataFrame([], SCHEMA), ["symbol", "ts"])
    assert nothing.count() == 102


def test_keys_without_the_date_are_one_partition(spark, store):
    out = store.upsert("k", spark.createDataFrame([("A", day(1), 1), ("B", day(50), 2)], SCHEMA), ["symbol"])
    out = store.upsert("k", spark.createDataFrame([("A", day(90), 3)], SCHEMA), ["symbol"])
    assert rows(out) == [("A", day(90), 3), ("B", day(50), 2)] and set(store.partitions("k")) == {"all"}


def test_replayed_batches_change_nothing(spark, store):
    put = lambda x, n: store.upsert("t", spark.createDataFrame([("A", day(5), x)], SCHEMA), ["symbol", "ts"],
                                    writer="stream", batch=n)
    put(50, 0)
    put(51, 1)
    v = store._versions("t")
    assert rows(put(50, 0)) == rows(put(99, 1)) and store._versions("t") == v
    assert store.load("t").where(F.col("ts") == day(5)).first()["x"] == 51 and store.applied("t", "stream") == 1


def test_a_save_that_broke_off_is_passed_over(spark, store, tmp_path):
    os.makedirs(tmp_path / "store" / "t" / "v=2" / "data-x")  # no snapshot was committed
    out = store.upsert("t", spark.createDataFrame([("A", day(0), -1)], SCHEMA), ["symbol", "ts"])
    assert out.where(F.col("ts") == day(0)).first()["x"] == -1 and store._versions("t") == [1, 2]


def test_two_writers_at_once(spark, store, monkeypatch):
    """Both start from the same version: the later one goes on from the
    other's; what both touched is merged anew, nothing is lost."""
    store.upsert("t", spark.createDataFrame([("A", day(0), 0)], SCHEMA), ["symbol", "ts"])
    ready, commit, merges = threading.Barrier(2), TableStore._commit, []
    merge = TableStore._merge
    first = threading.local()

    def together(self, *args):
        if not getattr(first, "passed", False):
            first.passed = True
            ready.wait(60)
        return commit(self, *args)

    def counted(self, *args):
        merges.append(threading.current_thread().name)
        return merge(self, *args)

    monkeypatch.setattr(TableStore, "_commit", together)
    monkeypatch.setattr(TableStore, "_merge", counted)
    for overlap, expected in ((False, 2), (True, 3)):
        merges.clear()
        new = [[("W1", day(1), 1)], [("W2", day(1 if overlap else 70), 2)]]
        ts = []
        for i in (0, 1):
            def go(i=i, new=new):
                first.passed = False
                store.upsert("t", spark.createDataFrame(new[i], SCHEMA), ["symbol", "ts"])
            ts.append(threading.Thread(target=go))
        [t.start() for t in ts]
        [t.join(120) for t in ts]
        got = rows(store.load("t"))
        assert new[0][0] in got and new[1][0] in got and len(merges) == expected
        assert len(got) == 100 + (3 if overlap else 2)
    folder = [n for n in store._names("t/v=3") if n == SNAPSHOT]
    assert folder == [SNAPSHOT]
