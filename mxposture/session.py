"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Every timestamp in the evidence tables is UTC; AQE re-plans joins from real sizes and
# splits skewed shuffle partitions, which the join-heavy operators rely on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles methods over 8000 bytes: larger fused stages run faster unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Plans are built from thousands of column calls; call-site capture doubles their cost.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "mxposture", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Folder the cluster names for checkpoints; None when the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so lost executors lose no work.

    Only local sessions without a named folder keep the lazy plan: the result is the same and
    nothing is written to a machine-local path.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return df
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` materialised now, for loops that read it again and again.

    Like ``checkpointed``, but a local session without a folder gets a temporary one of its own, since a
    lazy plan would be worked out anew, and grow, in every round.
    """
    spark = df.sparkSession
    if checkpoint_dir(spark) is None and is_local(spark):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mxposture-"))
        return df.checkpoint(eager=True)
    return checkpointed(df)
