"""Certificate places by fingerprint."""

import re

from pyspark.sql import functions as F

from mxposture.operators import certificates


def test_fingerprints_are_dealt_by_place_before_copies_are_dropped(spark):
    extracted = spark.range(50).select(
        F.lpad(F.col("id").cast("string"), 64, "0").alias("sha256"), F.lpad(F.col("id").cast("string"), 40, "0").alias("sha1")
    )
    rows = spark.range(400).select(
        (F.col("id") % 20).cast("string").alias("uid"),
        F.lit("server").alias("role"),
        (F.col("id") % 3).cast("int").alias("chain_index"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(" 00:"), F.lpad((F.col("id") % 60).cast("string"), 62, "0")))
        .otherwise(F.lpad((F.col("id") % 60).cast("string"), 40, "0"))
        .alias("fingerprint"),
    )
    out = certificates.match_fingerprints(rows, extracted)
    # No aggregate by place below the exchange: only the index of digests is grouped there.
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM") :]
    assert not re.search(r"Aggregate\(keys=\[uid", below)
    want = {(str(i % 20), i % 3, "server", str(i % 60).rjust(64, "0")) for i in range(400) if i % 60 < 50}
    got = [(r.uid, r.chain_index, r.role, r.der_sha256) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
