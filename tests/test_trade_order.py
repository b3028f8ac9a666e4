"""The order of trades inside a bar: digits of its keys, never cut."""

import datetime as dt

import pytest

from candleflow.sources import bars as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def trades(spark, ids):
    rows = [(i, dt.datetime(2024, 1, 1, 9), 1, "view", float(k), "") for k, i in enumerate(ids)]
    return S.trades_from_events(spark.createDataFrame(rows, SCHEMA))


def test_order_by_all_digits(spark):
    ids = [7, 10 ** 17 + 3, 10 ** 17 + 2, 70]
    got = [r["price"] for r in trades(spark, ids).orderBy("seq").collect()]
    assert got == [0.0, 3.0, 2.0, 1.0]


def test_keys_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="more than 18 digits"):
        trades(spark, [1, 10 ** 18]).select("seq").collect()
