"""Skew-safe building blocks.

A plain window puts one key into one task. These helpers split a key into chunks first, work
inside the chunks, and carry only one small row per chunk between them, so a key that holds a
third of the table is spread over the cluster and the result is still exact.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.session import checkpoint_dir, checkpointed, settled

CHUNK_ROWS = 100_000


def with_chunk(df: DataFrame, order: str, width: int = CHUNK_ROWS) -> DataFrame:
    """``_chunk`` grows with ``order``; ``order`` is the dense position inside the key."""
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def large_keys(df: DataFrame, keys: list[str], most: int = CHUNK_ROWS, weight: Column | None = None) -> DataFrame:
    """Keys with over ``most`` rows, worked out now; at most the rows over ``most`` keys are that large.

    ``weight`` bounds the rows that a row will become, where it is cheaper to count before they are made.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return settled(df.groupBy(*keys).agg(rows.alias("_n")).where(F.col("_n") > most).drop("_n"))


def marked_large(df: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """``df`` with ``_large``: true on rows of a large key, else null; a large key's rows stay where they are."""
    mark = hinted(large.withColumn("_large", F.lit(True)), large.count())
    matched = [df[k].eqNullSafe(mark[k]) for k in keys]
    return df.join(mark, matched, "left").select(*[df[c] for c in df.columns], "_large")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    width: int = CHUNK_ROWS,
    chunk: Column | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Running sums and last non-null values per key up to and including the row.

    The first order column is the position in the key, unless ``chunk`` (any non-decreasing
    function of the order) is given. Keys of up to ``width`` rows take a plain window, so one
    exchange by key serves them and whatever follows by key. Larger ones are cut into chunks: one
    exchange moves their rows (by key and chunk), and what passes from chunk to chunk is one row
    per chunk. ``counted``, a table with the same keys and at least as many rows of each, is
    counted instead of ``df`` where that is cheaper.
    """
    sums, lasts = sums or {}, lasts or {}
    large = large_keys(df if counted is None else counted, keys, width)
    if large.isEmpty():
        return _running_whole(df, keys, order, sums, lasts)
    marked = marked_large(df, keys, large)
    plain = _running_whole(marked.where("_large IS NULL").drop("_large"), keys, order, sums, lasts)
    cut = _running_chunks(marked.where("_large").drop("_large"), keys, order, sums, lasts, width, chunk)
    return plain.unionByName(cut)


def _running_whole(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {
            **{n: F.sum(e.cast("bigint")).over(so_far) for n, e in sums.items()},
            **{n: F.last(e, ignorenulls=True).over(so_far) for n, e in lasts.items()},
        }
    )


def _running_chunks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    lasts: dict[str, Column],
    width: int,
    chunk: Column | None,
) -> DataFrame:
    df = with_chunk(df, order[0], width) if chunk is None else df.withColumn("_chunk", chunk)
    df = df.withColumns({f"_v_{n}": e.cast("bigint") for n, e in sums.items()})
    df = df.withColumns({f"_v_{n}": e for n, e in lasts.items()})
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumns(
        {
            **{n: F.sum(f"_v_{n}").over(inside) for n in sums},
            **{n: F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in lasts},
        }
    )
    position = F.struct(*order)
    tails = df.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = tails.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts],
    )
    out = local.join(bases, [*keys, "_chunk"], "left")
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_b_{n}")) for n in lasts})
    names = [*sums, *lasts]
    return out.drop("_chunk", *[f"_v_{n}" for n in names], *[f"_b_{n}" for n in names])


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    width: int = CHUNK_ROWS,
) -> DataFrame:
    """Value of the row before in the key (``lag``), carried across chunk borders."""
    df = with_chunk(df, order[0], width).withColumn("_val", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = df.withColumn("_lag", F.lag("_val").over(inside))
    position = F.struct(*order)
    tails = df.groupBy(*keys, "_chunk").agg(F.max_by("_val", position).alias("_tail"))
    carry = tails.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
    )
    out = local.join(carry, [*keys, "_chunk"], "left")
    return out.withColumn(name, F.coalesce("_lag", "_carry")["v"]).drop(
        "_chunk", "_val", "_lag", "_carry"
    )


def cumulative_share(
    df: DataFrame, group: list[str], value: str, bucket: Column, name: str
) -> DataFrame:
    """(group, value, share): ``100 * count(x <= value) / n``, the group never in one task.

    Equal values collapse map-side first; ``bucket`` is any non-decreasing function of the value
    that cuts a group into a bounded number of pieces. Join the result back on group and value.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bk", bucket)
    buckets = counts.groupBy(*group, "_bk").agg(F.sum("_n").alias("_bn"))
    by_bucket = Window.partitionBy(*group).orderBy("_bk")
    whole = Window.partitionBy(*group)
    bases = buckets.select(
        *group,
        "_bk",
        (F.sum("_bn").over(by_bucket) - F.col("_bn")).alias("_base"),
        F.sum("_bn").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_bk").orderBy(value)
    share = F.lit(100.0) * (F.col("_base") + F.col("_in")) / F.col("_total")
    return (
        counts.withColumn("_in", F.sum("_n").over(inside))
        .join(bases, [*group, "_bk"])
        .select(*group, value, share.alias(name))
    )


EDGES = 1024
FEW_ROWS = 100_000


def hinted(few: DataFrame, rows: int) -> DataFrame:
    """``few`` as a join side that goes to every task only if its ``rows`` (or a bound of them) are few."""
    return few.hint("broadcast" if rows <= FEW_ROWS else "merge")


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """Join with a side that has about one row per key; the many rows are never the side sent around.

    Spark reckons sizes from the files that were read, and rows that were exploded or decoded since count for
    little there: left to it, ``rows`` may be gathered by the driver. ``few``, which must be settled, is counted
    and goes to every task if it really is small; otherwise both sides are shuffled. ``most`` bounds its rows
    where that is known without working it out.
    """
    return rows.join(hinted(few, few.count() if most is None else most), keys, how)


def join_named(rows: DataFrame, side: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Left join on a string ``key`` that many ``rows`` lack: these match nothing and are dealt by ``spread``.

    A plain left join sends every row without a key to one task.
    """
    dealt = F.concat(F.lit("?"), F.xxhash64(*spread).cast("string"))
    left = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), key), dealt))
    right = side.withColumn("_key", F.concat(F.lit("="), key)).drop(key)
    return left.join(right, "_key", "left").drop("_key")


def bucketed(df: DataFrame, value: str, name: str, edges: int = EDGES) -> DataFrame:
    """``name``: a bucket that does not decrease with ``value``, cut where the values are.

    A mergeable quantile sketch over all rows gives the edges (at most ``edges`` numbers reach the
    driver), so whatever the range or the shape, a bucket holds about 1 / ``edges`` of all rows, or one
    value that is more frequent than that.
    """
    share = [k / edges for k in range(1, edges)]
    cuts = sorted(set(df.approxQuantile(value, share, 0.5 / edges)))
    # Numbers that read as equal edges would be no cut.
    splits = [-float("inf"), *[c for c in cuts if abs(c) < float("inf")], float("inf")]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=name)
    return cut.transform(df).withColumn(name, F.col(name).cast("bigint"))


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, qs: dict[str, float], edges: int = EDGES
) -> DataFrame:
    """Linear-interpolation quantiles per group without collecting a group; nulls and NaN are left out.

    Pass 1 counts the rows of each group per bucket (see ``bucketed``); pass 2 looks only at the values
    of the buckets that hold the wanted ranks. Both passes aggregate map-side.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.withColumn(value, F.col(value).cast("double"))
    rows = bucketed(rows, value, "_bk", edges)
    buckets = rows.groupBy(*group, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_bk")
    whole = Window.partitionBy(*group)
    placed = buckets.select(
        *group,
        "_bk",
        (F.sum("_n").over(run) - F.col("_n")).alias("_from"),
        F.sum("_n").over(run).alias("_to"),
        F.sum("_n").over(whole).alias("_total"),
    )
    wanted = None
    for q in qs.values():
        rank = (F.col("_total") - 1) * F.lit(float(q))
        hit = (F.col("_to") > F.floor(rank)) & (F.col("_from") <= F.ceil(rank))
        wanted = hit if wanted is None else (wanted | hit)
    targets = settled(placed.where(wanted).drop("_to"))
    values = (
        join_few(rows, targets, [*group, "_bk"])
        .groupBy(*group, "_bk", "_from", "_total", value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy(*group, "_bk").orderBy(value)
    ranked = values.withColumn("_cum", F.col("_from") + F.sum("_n").over(inside))
    aggs = []
    for name, q in qs.items():
        rank = (F.col("_total") - 1) * F.lit(float(q))
        low = F.min(F.when(F.col("_cum") > F.floor(rank), F.col(value)))
        high = F.min(F.when(F.col("_cum") > F.ceil(rank), F.col(value)))
        weight = F.max(rank - F.floor(rank))
        aggs.append((low + (high - low) * weight).alias(name))
    if group:
        return ranked.groupBy(*group).agg(*aggs)
    return ranked.agg(*aggs)


def global_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Place of every row in a total order, without sorting the table in one task.

    A range exchange puts the rows into sorted pieces, each piece numbers its own rows, and the
    running piece sizes (one row per piece) are added. The pieces are materialised first, because
    a range exchange samples anew whenever it is computed again. ``order`` must be unique.
    """
    ranged = df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())
    if checkpoint_dir(df.sparkSession) is None:
        ranged = ranged.persist()
    else:
        ranged = checkpointed(ranged)
    sizes = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    return (
        ranged.withColumn("_in", inside)
        .join(bases, "_piece")
        .withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint"))
        .drop("_piece", "_in", "_base")
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, most: int = CHUNK_ROWS, large: DataFrame | None = None
) -> DataFrame:
    """``row_number`` of each key in ``order``, no key of any size in one task.

    Keys of up to ``most`` rows are numbered by a plain window. The rows of larger ones are dealt by range of
    (key, order) into sorted pieces; a piece numbers its own rows of a key and adds how many the pieces before
    hold, which is one small row per piece and key. Nulls in ``order`` come first, rows of equal order stay
    together. ``large`` names the larger keys, or some of their columns, where they are known already.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    if large is None:
        large = large_keys(df, keys, most)
    if large.isEmpty():
        return df.withColumn(name, F.row_number().over(by_key))
    marked = marked_large(df, large.columns, large)
    plain = marked.where("_large IS NULL").drop("_large").withColumn(name, F.row_number().over(by_key))
    pieces = settled(
        marked.where("_large").drop("_large").repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    )
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_piece", *keys).orderBy(*order))
    same = [F.col("_piece") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    split = pieces.withColumn("_in", inside).join(bases, same).withColumn(name, (F.col("_base") + F.col("_in")).cast("int"))
    return plain.unionByName(split.select(*plain.columns))
