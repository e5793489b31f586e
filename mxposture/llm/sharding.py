"""A uniform shuffle into shards of exact sizes, in DataFrame functions only.

1. The rows lie in P tasks. Each task puts its rows into a random order (a sort by a hash of the row
   and the seed, no exchange).
2. How many rows go from task p to each piece of a shard is drawn for all tasks at once: in a
   uniform shuffle this matrix has fixed row sums (the tasks' sizes) and column sums (the pieces'
   sizes) and is multivariate hypergeometric. The tasks are halved again and again; each halving
   draws how the columns' counts divide, one exact hypergeometric number per column, by inversion
   along the ratios of neighbouring probabilities.
3. A row finds its piece from its place in the task and the running sums of its task's matrix row.
   One exchange brings each piece together; a second random order gives the slots.

A shard is made of pieces of at most ``piece_rows`` rows whose sizes are known beforehand, so slots
need no further pass and no task holds a whole shard. Shard sizes differ by one at most.

Cases: rows may hold nulls and be equal; equal rows are dealt like any others. No rows: an empty
result. Existing columns ``shard`` and ``slot`` are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import settled

PIECE_ROWS = 1_000_000
REACH = 12.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 53 random bits, the same for the same parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``good`` ones, by inversion with ``u``.

    The sum runs over ``REACH`` deviations and ten more on both sides of the mean; what lies beyond
    is less than a double can tell from 0.
    """
    total_d, good_d, drawn_d = total.cast("double"), good.cast("double"), drawn.cast("double")
    mean = F.coalesce(F.try_divide(good_d * drawn_d, total_d), F.lit(0.0))
    variance = F.coalesce(
        F.try_divide(mean * (total_d - good_d) * (total_d - drawn_d), total_d * F.greatest(total_d - 1, F.lit(1.0))),
        F.lit(0.0),
    )
    reach = REACH * F.sqrt(variance) + 10
    low = F.greatest(F.lit(0).cast("long"), drawn + good - total, F.floor(mean - reach))
    high = F.least(good, drawn, F.ceil(mean + reach))

    def ratio(k: Column) -> Column:
        k = k.cast("double")
        return (good_d - k + 1) * (drawn_d - k + 1) / (k * (total_d - good_d - drawn_d + k))

    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), F.lit(0).cast("long").alias("below"))

    def summed(state: Column, k: Column) -> Column:
        w = state["w"] * ratio(k)
        return F.struct(w.alias("w"), (state["s"] + w).alias("s"), state["below"].alias("below"))

    whole = F.aggregate(steps, begin, summed, lambda s: s["s"])

    def counted(target: Column):
        def step(state: Column, k: Column) -> Column:
            w = state["w"] * ratio(k)
            passed = F.when(state["s"] <= target, F.lit(1)).otherwise(F.lit(0)).cast("long")
            return F.struct(w.alias("w"), (state["s"] + w).alias("s"), (state["below"] + passed).alias("below"))

        return step

    # An array of one element binds the target once for the whole second walk.
    picked = F.transform(F.array(whole * u), lambda t: F.aggregate(steps, begin, counted(t), lambda s: s["below"]))
    return low + picked[0]


def split_columns(columns: Column, total: Column, drawn: Column, *where: Column) -> Column:
    """One multivariate hypergeometric draw: of ``drawn`` rows, how many fall on each column."""
    begin = F.struct(
        total.alias("left"), drawn.alias("todo"), F.array().cast("array<bigint>").alias("out")
    )

    def step(state: Column, good: Column) -> Column:
        number = hypergeometric(good, state["left"], state["todo"], uniform(*where, F.size(state["out"])))
        return F.aggregate(
            F.array(number),
            state,
            lambda s, n: F.struct(
                (s["left"] - good).alias("left"), (s["todo"] - n).alias("todo"), F.concat(s["out"], F.array(n)).alias("out")
            ),
        )

    return F.aggregate(columns, begin, step, lambda s: s["out"])


def piece_sizes(rows: int, shards: int, piece_rows: int) -> tuple[int, list[int]]:
    """(pieces of a shard, sizes of all pieces, shard by shard).

    Shard sizes differ by one at most, and so do the sizes of a shard's pieces.
    """
    n = max(1, -(-rows // shards // piece_rows)) if rows else 1
    sizes = [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return n, [size // n + (k < size % n) for size in sizes for k in range(n)]


def matrix(sizes: DataFrame, pieces: list[int], seed: int) -> DataFrame:
    """(task, counts): how many rows of each task go to each piece. ``sizes`` is (task, place, n).

    ``place`` numbers the tasks from 0. A node of the tree holds a stretch of 2^level places and the
    column counts of all its rows; it is halved by one draw.
    """
    spark = sizes.sparkSession
    stretch = sizes.agg(F.max("place").alias("last"), F.sum("n").alias("n")).first()
    level = max(0, int(stretch["last"]).bit_length())
    tree = spark.range(1).select(
        F.lit(0).cast("long").alias("node"),
        F.lit(int(stretch["n"])).cast("long").alias("n"),
        F.array(*[F.lit(p).cast("long") for p in pieces]).alias("counts"),
    )
    for depth in range(level - 1, -1, -1):
        # Rows of the left half of each node; a node's number is its first place >> depth.
        of = F.floor(F.col("place") / (1 << depth)).cast("long")
        halves = sizes.groupBy(of.alias("half")).agg(F.sum("n").alias("n"))
        left = halves.where(F.col("half") % 2 == 0).select(
            F.floor(F.col("half") / 2).cast("long").alias("node"), F.col("n").alias("drawn")
        )
        drawn = split_columns(F.col("counts"), F.col("n"), F.col("drawn"), F.lit(seed), F.lit(depth), F.col("node"))
        nodes = tree.join(left, "node").withColumn("first", drawn)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("drawn").alias("n"), F.col("first").alias("counts")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                (F.col("n") - F.col("drawn")).alias("n"),
                F.zip_with("counts", "first", lambda a, b: a - b).alias("counts"),
            ),
        )
        tree = nodes.select(F.explode(children).alias("c")).select("c.*").where("n > 0")
        if depth % 6 == 0:
            tree = settled(tree.repartition("node") if level - depth >= 6 else tree)
    return tree.join(sizes.select("task", F.col("place").alias("node")), "node").select("task", "counts")


def deal(rows: DataFrame, shards: int, seed: int = 1, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard)."""
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    packed = rows.select(own).withColumn("first_key", F.xxhash64(F.lit(seed), "row"))
    packed = packed.withColumn("second_key", F.xxhash64(F.lit(~seed), "row"))
    ordered = packed.sortWithinPartitions("first_key", "second_key").withColumn("at", F.monotonically_increasing_id())
    placed = settled(
        ordered.select(
            "row",
            "second_key",
            F.shiftright("at", 33).alias("task"),
            F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank"),
        )
    )
    counted = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    numbered = counted.withColumn("place", F.row_number().over(Window.orderBy("task")) - 1)
    sizes = settled(numbered)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    per_shard, pieces = piece_sizes(int(total), shards, piece_rows)
    if not total:
        return placed.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    dealt = matrix(sizes, pieces, seed)
    running = F.aggregate(
        "counts",
        F.array(F.lit(0).cast("long")),
        lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)),
    )
    bounds = dealt.select("task", running.alias("bounds"))

    def narrower(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = F.element_at("bounds", middle + 1) > F.col("rank")
        return F.struct(
            F.when(above, state["low"]).otherwise(middle).alias("low"),
            F.when(above, middle).otherwise(state["high"]).alias("high"),
        )

    # bounds[piece] <= rank < bounds[piece + 1], by halving.
    halvings = F.sequence(F.lit(1), F.lit(max(1, len(pieces).bit_length())))
    span = F.struct(F.lit(0).alias("low"), F.lit(len(pieces)).alias("high"))
    piece = F.aggregate(halvings, span, narrower, lambda s: s["low"])
    to_piece = placed.join(bounds, "task").select("row", "second_key", "rank", "task", piece.alias("piece"))
    inside = Window.partitionBy("piece").orderBy("second_key", "task", "rank")
    out = to_piece.withColumn("local", F.row_number().over(inside) - 1)
    shard = F.floor(F.col("piece") / per_shard).cast("int")
    number = F.col("piece") % per_shard
    size = F.lit(total // shards) + F.when(shard < total % shards, F.lit(1)).otherwise(F.lit(0))
    first = number * F.floor(size / per_shard) + F.least(number, size % per_shard)
    return out.select("row.*", shard.alias("shard"), (first + F.col("local")).cast("long").alias("slot"))
