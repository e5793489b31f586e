"""Running streams to completion over new files, and exactly-once tables behind them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.session import checkpoint_dir, is_local
from mxposture.sources.logs import LOG_SCHEMAS
from mxposture.streaming.ordered import LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder for a stream below the shared checkpoint folder the cluster names.

    Only a local session without such a folder (a test) falls back to a temporary one.
    """
    base = checkpoint_dir(spark)
    if base is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="mxposture-")
    return f"{base}/streams/{name}-{uuid.uuid4().hex}"


def log_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """New log files of one kind as they arrive."""
    reader = spark.readStream.schema(LOG_SCHEMAS[name]).option("pathGlobFilter", f"{name}*.log")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(directory)


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table directory as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def files_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder, a bounded number in each micro-batch, in no promised order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_upserts(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Process everything that is there now. Each micro-batch owns one folder and overwrites it
    when it is repeated, so a restart neither loses nor doubles rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key from the batches written so far."""
    rows = spark.read.parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), F.col("batch")).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


END_OF_INPUT = "2200-01-01"  # pandas holds times up to 2262


def run_ordered(
    spark: SparkSession, build: Callable[[DataFrame], DataFrame], name: str
) -> tuple[DataFrame, DataFrame]:
    """Run an ordered fold over what is there now and to its end; (results, late rows).

    ``build`` gets a stream of ticks. When the input is used up, one tick at the end of time makes all
    rows due and all sessions end; the same query goes on from its checkpoint for that.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    path = work_dir(spark, name)
    tick = spark.range(1).select(F.lit(END_OF_INPUT).cast("timestamp").alias("ts"))
    tick.limit(0).write.parquet(f"{path}/ticks")
    try:
        for last in (False, True):
            if last:
                tick.write.mode("append").parquet(f"{path}/ticks")
            run_upserts(build(spark.readStream.schema(tick.schema).parquet(f"{path}/ticks")), path, "append")
    finally:
        spark.conf.set(_PROVIDER, before)
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    return rows.where(F.col(LATE).isNull()).drop(LATE), rows.where(F.col(LATE).isNotNull()).select(LATE)
