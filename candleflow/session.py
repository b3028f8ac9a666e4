"""Session construction and lineage cutting.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are *unset*, so cluster-provided values (shuffle
partitions, checkpoint directory, ...) always win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: application id -> scratch folder of a local session without a setting
_SCRATCH: dict[str, str] = {}

# Settings applied only when the running session does not already define them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "candleflow") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        builder = (builder
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("CANDLEFLOW_DRIVER_MEMORY", "16g"))
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
        spark = builder.getOrCreate()
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a *local* master that leaves
    it unset (tests) gets a scratch folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder is not seen by the
    other machines.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None) or _SCRATCH.get(sc.applicationId)
    if not configured:
        if not re.match(r"local(\[[^-]|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="candleflow-ckpt-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used before iterative work (tuning loops) so a lost executor re-reads the
    checkpoint instead of replaying the whole feature lineage.  Never a
    local checkpoint: those die with the executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder, read it back.

    Used where a derived table feeds several branches of one plan (two-level
    scans join a table with an aggregate of itself): the expensive lineage
    (trade scan + bar aggregation) runs once, branches re-read a small
    columnar table with pruning, and a lost executor re-reads files instead
    of replaying the lineage.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def join_small(df: DataFrame, side: DataFrame, on, rows: int = 100_000) -> DataFrame:
    """Join ``side`` (one row per series or the like) to a large ``df``.

    The side is written and counted; up to ``rows`` it is broadcast, so the
    large side is not shuffled by a key that few values share.  A larger side
    is joined as usual, where skewed keys are split at run time.
    """
    from pyspark.sql import functions as F

    side = materialize(side, "side")
    return df.join(F.broadcast(side) if side.limit(rows + 1).count() <= rows else side, on)
