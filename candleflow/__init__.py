"""candleflow: analytics over many ordered, keyed price series on Spark.

Every operator is a lazy DataFrame transformation over a panel
``(symbol, ts, ...)``.  Ordered work is partitioned by ``symbol`` *and* by a
bar-number chunk (see :mod:`candleflow.plans.series`), so a single hot symbol
is still spread over many tasks.
"""

import sys

from pyspark import cloudpickle

from candleflow.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]

# Python kernels travel to the workers by value: executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
