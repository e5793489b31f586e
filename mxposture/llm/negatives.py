"""Hard negatives by an R-tree packed with sort-tile-recursive (STR) order.

Index. Rows are cut into slabs along one coordinate and inside a slab along a second one by a range
exchange (ties by id, so equal vectors spread over tasks like any others). Each task then tiles its rows
along a third coordinate into pages of ``PAGE`` rows and keeps, per page, the least and the greatest value
of every coordinate; ``FAN`` pages in a row form a node. The
coordinates and the slabs' limits come from a sample of at most ``SAMPLE`` rows; every row is indexed.

Search. For an anchor a and a box [l, u], the inner product lies between a+ . l + a- . u and
a+ . u + a- . l (a+ and a- being the positive and negative part). Each task takes its nodes from a
best-first queue, for a block of anchors at once: a node leaves if no anchor of the block can find in it
a row that beats its kth best so far or lies in its score window. A box is left out only strictly below
the kth score, or at it if all its ids come later. The sample's rows give the first kth scores.

    1. positives: the first ``n_positives`` other rows of the anchor's label
    2. negatives: the first ``n_negatives`` rows of other labels inside each positive's score window

Anchors travel in rounds of at most ``ROUND_BYTES`` as a broadcast; each task gives back the best few per
anchor, and a window over those few ends the search. So memory is bounded by a round and a task's rows.

Scores are exact: integer components, added as doubles while every sum stays below 2^53, as 64-bit
integers below 2^63; larger components are refused with a ValueError.

Cases: rows without an id, label or vector, or with a null or non-finite component, take no part. Vectors
of different lengths count as zero beyond their ends. Rows that share an id are rows of their own, but
"other rows" are those with another id; equal anchors are one anchor. No rows or no anchors: an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import prefixed, settled

PAGE = 128
FAN = 16
TASK_ROWS = 8192
SAMPLE = 2048
ROUND_BYTES = 16 << 20
BLOCK = 256
_LAST = np.int64(2**63 - 1)


def integer_vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """id, label and floor(scale * component) of the rows that take part."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
    whole = F.transform(parts, lambda x: F.floor(x * scale).cast("long"))
    return named.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


def _matrix(lists: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Rows of numbers, zeros beyond the end of a short one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(kind)
    out = np.zeros((len(sizes), dims), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shape:
    """What the index is built by: lengths, number type, cutting coordinates and slab limits."""

    def __init__(self, rows: int, dims: int, greatest: int, sample: np.ndarray):
        if dims * greatest**2 >= 2**63:
            raise ValueError(f"inner products of {dims} components up to {greatest} do not fit into 64 bits")
        self.dims = dims
        self.kind = np.float64 if dims * greatest**2 < 2**53 else np.int64
        self.type = "smallint" if greatest < 2**15 else "int" if greatest < 2**31 else "bigint"
        self.tasks = max(1, math.ceil(rows / TASK_ROWS))
        spread = sample.std(axis=0) if len(sample) else np.zeros(dims)
        self.cut = [int(k) for k in np.argsort(-spread, kind="stable")[:3]]
        slabs = math.ceil(math.sqrt(self.tasks))
        if self.cut and slabs > 1:
            self.limits = sorted({int(x) for x in np.quantile(sample[:, self.cut[0]], np.arange(1, slabs) / slabs)})
        else:
            self.limits = []


def packed_tree(rows: DataFrame, shape: Shape) -> DataFrame:
    """One row per page, in the order of the tiles."""
    rows = rows.withColumn("v", F.col("v").cast(f"array<{shape.type}>"))
    if not shape.cut:
        ranged = rows.repartition(shape.tasks)
    else:
        first, second = (F.coalesce(F.get("v", F.lit(k)), F.lit(0)) for k in (shape.cut * 2)[:2])
        slab = F.lit(0)
        for limit in shape.limits:
            slab = slab + (first > limit).cast("int")
        ranged = rows.repartitionByRange(shape.tasks, slab, second, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, labels = table.column(0).to_numpy(), table.column(1).to_numpy()
        vectors = _matrix(table.column(2), shape.dims, np.int64)
        number = pa.list_({"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[shape.type])
        for part in tiles(vectors, ids, shape.cut):
            box = vectors[part]
            columns = [pa.array([x], pa.list_(pa.int64())) for x in (ids[part], labels[part])]
            columns += [pa.array([x], number) for x in (box.ravel(), box.min(axis=0), box.max(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "vectors", "low", "high"])

    numbers = ", ".join(f"{c} array<{shape.type}>" for c in ("vectors", "low", "high"))
    return settled(ranged.mapInArrow(pack, f"ids array<long>, labels array<long>, {numbers}"))


def tiles(vectors: np.ndarray, ids: np.ndarray, cut: list[int]) -> Iterator[np.ndarray]:
    """Row numbers of the pages of one task: slices along one coordinate, pages along the next."""
    n = len(ids)
    second, third = (vectors[:, k] if k is not None else np.zeros(n) for k in ([*cut, None, None][1:3]))
    order = np.lexsort((ids, second))
    pages = math.ceil(n / PAGE)
    wide = math.ceil(pages / math.ceil(math.sqrt(pages))) * PAGE
    for at in range(0, n, wide):
        part = order[at : at + wide]
        part = part[np.lexsort((ids[part], third[part]))]
        for k in range(0, len(part), PAGE):
            yield np.sort(part[k : k + PAGE])


class Tree:
    """The pages of one task with their boxes, and the nodes above them."""

    def __init__(self, batches: list[pa.RecordBatch], shape: Shape):
        table = pa.Table.from_batches(batches)
        self.ids = [x.values.to_numpy() for x in table.column("ids")]
        self.labels = [x.values.to_numpy() for x in table.column("labels")]
        self.vectors = [x.values.to_numpy().reshape(-1, shape.dims).astype(shape.kind) for x in table.column("vectors")]
        low, high = (_matrix(table.column(c), shape.dims, shape.kind) for c in ("low", "high"))
        first_id = np.array([x.min() for x in self.ids])
        self.levels = [(low, high, first_id)]
        while len(self.levels[-1][2]) > FAN:
            low, high, first_id = self.levels[-1]
            at = np.arange(0, len(first_id), FAN)
            self.levels.append(
                (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first_id, at))
            )


class Best:
    """The first ``k`` rows of each of several queries, by score, then id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), _LAST)
        self.found = np.zeros(queries, np.int64)
        #: Least score of interest: a bound known beforehand, later the kth score.
        self.floor = floor.copy()
        self.floor_id = np.full(len(floor), _LAST)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        held = np.arange(self.k)[None, :] < self.found[touched][:, None]
        query = np.concatenate([query, np.repeat(touched, held.sum(axis=1))])
        score = np.concatenate([score, self.score[touched][held]])
        ids = np.concatenate([ids, self.id[touched][held]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        start = np.searchsorted(query, touched)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        top = rank < self.k
        self.score[query[top], rank[top]], self.id[query[top], rank[top]] = score[top], ids[top]
        self.found[touched] = np.minimum(self.k, np.diff(np.append(start, len(query))))
        full = touched[self.found[touched] == self.k]
        last = self.k - 1
        self.floor[full], self.floor_id[full] = self.score[full, last], self.id[full, last]


class Queries:
    """A block of anchors; each asks ``slots`` questions with score windows of their own."""

    def __init__(self, ids, labels, vectors, low, high, floor, k: int, other: bool):
        self.ids, self.labels, self.vectors, self.other = ids, labels, vectors, other
        self.positive, self.negative = np.maximum(vectors, 0), np.minimum(vectors, 0)
        self.low, self.high = low, high
        self.slots = low.shape[1]
        self.best = Best(low.size, k, np.maximum(low, floor).ravel())

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of every anchor in every box."""
        least = self.positive @ low.T + self.negative @ high.T
        most = self.positive @ high.T + self.negative @ low.T
        return least.astype(np.int64), most.astype(np.int64)

    def open(self, least: np.ndarray, most: np.ndarray, first_id) -> np.ndarray:
        """Per anchor and box, whether some slot may find something in it."""
        out = np.zeros(most.shape, bool)
        for s in range(self.slots):
            floor = self.best.floor[s :: self.slots][:, None]
            later = first_id > self.best.floor_id[s :: self.slots][:, None]
            out |= (most >= floor) & ~((most == floor) & later) & (least <= self.high[:, s][:, None])
        return out

    def look(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        score = (self.vectors[anchors] @ vectors.T).astype(np.int64)
        fits = (self.labels[anchors][:, None] == labels[None, :]) != self.other
        fits &= self.ids[anchors][:, None] != ids[None, :]
        for s in range(self.slots):
            query = anchors * self.slots + s
            floor, floor_id = self.best.floor[query][:, None], self.best.floor_id[query][:, None]
            good = fits & (score >= floor) & (score <= self.high[anchors, s][:, None])
            good &= (score > floor) | (ids[None, :] < floor_id)
            a, r = np.nonzero(good)
            if len(a):
                self.best.add(query[a], score[a, r], ids[r])


def searched(tree: Tree, queries: Queries) -> None:
    """Best-first over the nodes, the most promising box of the block first."""
    heap: list[tuple[int, int, int]] = []

    def push(level: int, nodes: np.ndarray) -> None:
        low, high, first_id = tree.levels[level]
        least, most = queries.bounds(low[nodes], high[nodes])
        usable = queries.open(least, most, first_id[nodes][None, :])
        for j in np.flatnonzero(usable.any(axis=0)).tolist():
            anchors = np.flatnonzero(usable[:, j])
            heapq.heappush(heap, (-int(most[anchors, j].max()), level, int(nodes[j])))

    push(len(tree.levels) - 1, np.arange(len(tree.levels[-1][2])))
    while heap:
        _, level, node = heapq.heappop(heap)
        if level:
            push(level - 1, np.arange(node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][2]))))
            continue
        low, high, first_id = (x[node : node + 1] for x in tree.levels[0])
        least, most = queries.bounds(low, high)
        anchors = np.flatnonzero(queries.open(least, most, first_id[None, :])[:, 0])
        if len(anchors):
            queries.look(anchors, tree.ids[node], tree.labels[node], tree.vectors[node])


FOUND = "query long, id long, score long"


def search(index: DataFrame, shape: Shape, anchors: tuple, low, high, floor, k: int, other: bool) -> DataFrame:
    """(query, id, score): the best ``k`` of each task for every anchor and slot, then of all tasks.

    A query is numbered anchor * slots + slot.
    """
    shared = index.sparkSession.sparkContext.broadcast((anchors, low, high, floor))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        tree = Tree(batches, shape)
        (ids, labels, vectors), low, high, floor = shared.value
        slots = low.shape[1]
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            queries = Queries(ids[part], labels[part], vectors[part].astype(shape.kind), low[part], high[part], floor[part], k, other)
            searched(tree, queries)
            held = np.arange(k)[None, :] < queries.best.found[:, None]
            query = np.repeat(np.arange(len(held)) + at * slots, held.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(queries.best.id[held]), pa.array(queries.best.score[held])],
                names=["query", "id", "score"],
            )

    # At most ``k`` rows of a query leave a task, and the rank's limit cuts them again before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return index.mapInArrow(scan, FOUND).withColumn("rank", rank).where(F.col("rank") <= k)


def _kth_scores(anchors: tuple, sample: tuple, k: int, kind: type) -> np.ndarray:
    """The kth best score of each anchor among the sample's rows of its label, if there are k."""
    ids, labels, vectors = anchors
    out = np.full(len(ids), -(2**63), np.int64)
    if len(sample[0]) < k:
        return out
    right = sample[2].astype(kind).T
    for at in range(0, len(ids), 4096):
        part = slice(at, at + 4096)
        score = (vectors[part].astype(kind) @ right).astype(np.int64)
        fits = (labels[part][:, None] == sample[1][None, :]) & (ids[part][:, None] != sample[0][None, :])
        score[~fits] = -(2**63)
        out[part] = np.partition(score, len(sample[0]) - k, axis=1)[:, len(sample[0]) - k]
    return out


def _collected(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = rows.select("id", "label", "v").toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2), dims, np.int64)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """Hard negatives of every row that ``is_anchor`` (a condition on ``id``) holds for.

    A negative's score lies between ``window`` percent of the positive's. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    whole = integer_vectors(rows, key, vector, F.col("label") if label is None else label, scale)
    facts = whole.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("v")).alias("dims"),
        F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most"),
        F.count_if(is_anchor).alias("anchors"),
    ).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], RESULT)
    dims, most = max(1, facts["dims"]), facts["most"] or 0
    step = max(1, facts["rows"] // SAMPLE)
    sample = _collected(whole.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(step)) == 0).limit(SAMPLE), dims)
    shape = Shape(facts["rows"], dims, most, sample[2])
    index = packed_tree(whole, shape)

    rounds = max(1, math.ceil(facts["anchors"] * (8 * dims + 64) / ROUND_BYTES))
    turn = prefixed(["id", "label", "v"], "round")
    chosen = whole.where(is_anchor).distinct().withColumn(turn, F.pmod(F.xxhash64("id", F.lit(11)), F.lit(rounds)))
    out = []
    for number in range(rounds):
        anchors = _collected(chosen.where(F.col(turn) == number), dims)
        n = len(anchors[0])
        if not n:
            continue
        everything = np.full((n, 1), -(2**63), np.int64), np.full((n, 1), 2**63 - 1, np.int64)
        floor = _kth_scores(anchors, sample, n_positives, shape.kind)[:, None]
        near = search(index, shape, anchors, *everything, floor, n_positives, False).toArrow()
        query, rank, ids, score = (near.column(c).to_numpy() for c in ("query", "rank", "id", "score"))
        # Slots without a positive get an empty window.
        low, high = np.full((n, n_positives), 1, np.int64), np.zeros((n, n_positives), np.int64)
        exact = score.astype(object)  # a percentage of a score may pass 64 bits on its way
        low[query, rank - 1] = -((-window[0] * exact) // 100)
        high[query, rank - 1] = window[1] * exact // 100
        hard = search(index, shape, anchors, low, high, np.full((n, 1), -(2**63), np.int64), n_negatives, True)
        positives = spark.createDataFrame(
            pa.table({"query": query * n_positives + rank - 1, "anchor_id": anchors[0][query], "positive_id": ids, "positive_score": score})
        )
        out.append(
            hard.join(F.broadcast(positives), "query").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            )
        )
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
