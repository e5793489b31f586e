"""Pick-up of finished captures with the analysis behind it.

A capture is a folder of logs; whoever writes it puts a file ``READY`` there last (of any content but none:
Spark's binary reader does not list empty files). A run looks at the
names, sizes and times of the files, takes the finished captures that are new or have changed since they
were analysed, and analyses only those. Results of a run lie in folders of that run; a small keyed table
says which run holds each capture, and readers follow it. So a run that is repeated replaces itself, one
that broke off leaves nothing to see, and a capture that was analysed again has only its newest results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.sources.logs import LOG_SCHEMAS, read_log
from mxposture.streaming.versions import VersionedTable

READY = "ready"
_SEEN = "capture_id string, fingerprint string, run bigint"

Analysis = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def finished_captures(spark: SparkSession, directory: str) -> DataFrame:
    """(capture_id, fingerprint) of the folders below ``directory`` that hold the marker."""
    files = spark.read.format("binaryFile").load(f"{directory}/*/*").select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    one = F.xxhash64(name, "length", "modificationTime")
    # Two sums of independent hashes and a count: the same for any order of the files.
    return (
        files.groupBy(F.element_at(F.split("path", "/"), -2).alias("capture_id"))
        .agg(
            F.max(name == READY).alias("_done"),
            F.concat_ws(
                "-",
                F.count(F.lit(1)),
                F.sum(one.cast("decimal(38,0)")),
                F.sum(F.crc32(F.concat_ws("|", name, "length", F.unix_micros("modificationTime")).cast("binary"))),
            ).alias("fingerprint"),
        )
        .where("_done")
        .drop("_done")
    )


class Pickup:
    """Analyses captures as they are finished. ``out`` lies in a folder that all executors share."""

    def __init__(self, spark: SparkSession, directory: str, out: str, analysis: Analysis, at_once: int = 1000):
        self.spark, self.directory, self.out = spark, directory, out
        self.analysis, self.at_once = analysis, at_once
        self.seen = VersionedTable(spark, f"{out}/seen", ["capture_id"], _SEEN)

    def waiting(self) -> DataFrame:
        """Finished captures that are new or changed, by name."""
        seen = self.seen.read().select("capture_id", F.col("fingerprint").alias("_old"))
        now = finished_captures(self.spark, self.directory)
        fresh = now.join(seen, "capture_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old")))
        return fresh.drop("_old").orderBy("capture_id")

    def run(self) -> list[str]:
        """One lot of at most ``at_once`` captures; their names, none when all is done."""
        lot = self.waiting().limit(self.at_once).collect()
        if not lot:
            return []
        names = [r["capture_id"] for r in lot]
        last = self.seen.read().agg(F.max("run")).first()[0]
        run = 0 if last is None else last + 1
        for table, rows in self.analysis(self._logs(names)).items():
            if "capture_id" not in rows.columns and "uid" in rows.columns:
                rows = rows.withColumn("capture_id", F.element_at(F.split("uid", r"\|"), 1))
            if "capture_id" in rows.columns:
                rows.write.mode("overwrite").parquet(f"{self.out}/{table}/run={run}")
        # Only now readers see the run.
        state = self.spark.createDataFrame([(*r, run) for r in lot], _SEEN)
        self.seen.merge(state, run)
        return names

    def run_all(self) -> list[str]:
        done: list[str] = []
        while lot := self.run():
            done += lot
        return done

    def read(self, table: str) -> DataFrame:
        """The table's rows of every capture's newest run."""
        rows = self.spark.read.parquet(f"{self.out}/{table}")
        newest = self.seen.read().select("capture_id", "run")
        return rows.join(newest, ["capture_id", "run"]).drop("run")

    def _logs(self, names: list[str]) -> dict[str, DataFrame]:
        """The logs of these captures; a log that a capture lacks has no rows of it."""
        files = self.spark.read.format("binaryFile").load([f"{self.directory}/{n}" for n in names]).select("path")
        found: dict[str, list[str]] = {}
        for r in files.collect():  # at most ``at_once`` captures of a handful of files
            found.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r["path"])
        out = {}
        for name in LOG_SCHEMAS:
            paths = found.get(f"{name}.log")
            if paths:
                out[name] = read_log(self.spark, paths, name)
            else:
                empty = self.spark.createDataFrame([], LOG_SCHEMAS[name])
                out[name] = empty.withColumns({"source_file": F.lit(""), "source_ord": F.lit(0).cast("bigint")})
        return out
