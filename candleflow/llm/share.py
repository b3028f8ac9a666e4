"""Broadcast of model objects whose classes the workers cannot import.

The object travels pickled by value; a worker unpacks it once and keeps it
for all its tasks, together with what the object itself remembers.
"""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, thing):
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def shared(broadcast):
    found = broadcast.__dict__.get("_candleflow")
    if found is None:
        found = broadcast.__dict__["_candleflow"] = pickle.loads(broadcast.value)
    return found
