"""Session settings shared by tests, the benchmark and batch jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Run-time SQL settings; all of them can be changed on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ledgerline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoints go away with the DataFrames that wrote them.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    A session on one machine that names none, as in a test, gets a temporary
    folder; on a cluster that is an error, as machines do not see each other's.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    local = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later reads do not run
    its plan again and survive lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()
