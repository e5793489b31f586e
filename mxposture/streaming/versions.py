"""A keyed table behind a stream: idempotent upserts by batch, compaction, restart.

Every micro-batch writes the newest rows of its keys into a folder of its own and overwrites that folder
if it is repeated, so a batch counts once however often it runs. Now and then the batches so far are merged
into one base folder, named by the last batch it holds; readers take the newest base and the batches after
it. A base that was not finished has no success marker and is not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "batch"


class VersionedTable:
    """Newest row of each key. ``path`` lies in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, every: int = 16):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path, keys, schema, every

    def merge(self, rows: DataFrame, batch: int) -> None:
        """The rows of one batch; the batch with the same number before is replaced."""
        self._newest(rows.withColumn(_BATCH, F.lit(batch))).drop(_BATCH).write.mode("overwrite").parquet(
            f"{self.path}/batches/{_BATCH}={batch}"
        )
        if batch % self.every == self.every - 1:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """All batches up to this one as one base."""
        self._rows(upto).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")

    def read(self) -> DataFrame:
        return self._rows(None).drop(_BATCH)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, _BATCH)]
        newest = F.max_by(F.struct(*rest), F.struct(_BATCH, *rest)).alias("_r")
        return rows.groupBy(*self.keys).agg(newest, F.max(_BATCH).alias(_BATCH)).select(*self.keys, "_r.*", _BATCH)

    def _finished(self, folder: str) -> list[int]:
        """Numbers of the folders below that were written to their end."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(path(f"{self.path}/{folder}")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(f"{self.path}/{folder}"))]
        done = [n for n in names if "=" in n and files.exists(path(f"{self.path}/{folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def _rows(self, upto: int | None) -> DataFrame:
        bases = [b for b in self._finished("base") if upto is None or b < upto]
        base = bases[-1] if bases else None
        later = [b for b in self._finished("batches") if (base is None or b > base) and (upto is None or b <= upto)]
        reader = self.spark.read.schema(self.schema)
        parts = [reader.parquet(f"{self.path}/batches/{_BATCH}={b}").withColumn(_BATCH, F.lit(b)) for b in later]
        if base is not None:
            parts.insert(0, reader.parquet(f"{self.path}/base/upto={base}").withColumn(_BATCH, F.lit(base)))
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn(_BATCH, F.lit(0))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return self._newest(whole)


def run_into(stream: DataFrame, table: VersionedTable, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run an update stream over what is there now into ``table``; ``change`` shapes each batch first.

    Started again with the same checkpoint it goes on where it stopped; a batch that had not been
    acknowledged runs again under its number.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch if change is None else change(batch), number)

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
