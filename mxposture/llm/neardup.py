"""Near duplicates by an inverted join over MinHash coordinates, confirmed on whole shingle sets.

1. Each text becomes the set of its distinct ``width``-word shingles (64-bit hashes) and a signature
   of ``COORDINATES`` minima. Texts with equal sets form one class and go on as one.
2. A class is posted under each of its (coordinate, value) pairs. Pairs that occur once can join
   nothing. Ordered from the rarest pair to the most frequent, two signatures that agree in
   ``MATCHES`` of n places share one of their first n - MATCHES + 1 pairs; only this prefix is
   posted for joining, so the long lists of common passages are skipped.
3. Lists are merged into clusters: in two rounds every class meets the head of its lists, then one
   member of each cluster in a list meets another's, and those whose signatures agree in MATCHES
   places fall into one cluster. So a large group of copies forms through few pairs. Then, in lists
   that still hold several clusters, members outside the list's largest cluster meet the others.
4. Links are confirmed by the exact size of intersection and union of the sets: inside a cluster by
   looking up each class's shingles among the others', between clusters pair by pair. A cluster of
   more than a block is cut: classes that its star already links are settled and only looked up,
   the others are compared with every block. Only links that join something new are passed on.

With 64 coordinates a pair at similarity 0.8 agrees in fewer than 36 places with probability 4e-6.
Result: one row per document with its component, never a list of all pairs of a group.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing. A
text of fewer words than ``width`` has the whole sequence as its one shingle. Rows without doc_id
take part through equal sets only. A component is named by its smallest doc_id. Repeated rows get
equal results. No documents: an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, empty_text, prefixed, released, settled, slices
from mxposture.llm.components import components
from mxposture.llm.words import LOWER, SPACE, mixed, shingles, span_hashes, spans

COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
BLOCK_TEXTS = 4096
LIST_BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
CLASSES_PER_TASK = 20_000

_RANDOM = np.random.default_rng(7321)
_MULTIPLIERS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles, sorted, from bounds[i] to bounds[i + 1]."""
    n = len(offsets) - 1
    lower = LOWER[data]
    starts, ends, owner = spans(~SPACE[lower], offsets)
    words = span_hashes(lower, starts, ends)
    found, place = shingles(words, owner, width)
    of = owner[place]
    per_text = np.bincount(owner, minlength=n)
    for size in range(1, width):
        # Texts of exactly ``size`` words: one shingle, told apart from others by its size.
        short, at = shingles(words, owner, size)
        alone = per_text[owner[at]] == size
        found = np.concatenate([found, mixed(short[alone] ^ np.uint64(size))])
        of = np.concatenate([of, owner[at][alone]])
    order = np.argsort(found)
    narrow = np.uint16 if n <= 1 << 16 else np.uint32
    order = order[np.argsort(of[order].astype(narrow), kind="stable")]
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(of[new], minlength=n), out=bounds[1:])
    return found[new], bounds


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row a set, the minimum of each coordinate's hash; ``starts`` of non-empty sets."""
    out = np.empty((len(starts), COORDINATES), np.int32)
    for k in range(COORDINATES):
        values = ((hashes ^ _MASKS[k]) * _MULTIPLIERS[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(values, starts).astype(np.uint32).view(np.int32)
    return out


def digest(text: str) -> dict[str, Column]:
    return {"_text_a": F.xxhash64(empty_text(text)), "_text_b": F.xxhash64(empty_text(text), F.lit(1))}


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text digest, set size, set digest and signature (null for an empty set)."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        *[c.alias(n) for n, c in digest(text).items()],
        empty_text(text).alias("text"),
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = shingle_sets(*byte_offsets(batch.column(3)), width)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            first, second = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            lists = np.zeros(len(n) + 1, np.int32)
            values = np.zeros(0, np.int32)
            if len(full):
                starts = bounds[:-1][full]
                first[full] = np.add.reduceat(mixed(hashes), starts)
                second[full] = np.bitwise_xor.reduceat(hashes, starts)
                values = signatures(hashes, starts).ravel()
                lists[1:] = np.cumsum((n > 0) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(3)],
                    pa.array(n),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(values)),
                ],
                names=["doc_id", "_text_a", "_text_b", "n_shingles", "set_a", "set_b", "signature"],
            )

    schema = (
        "doc_id long, _text_a long, _text_b long, n_shingles long, set_a long, set_b long, signature array<int>"
    )
    return rows.mapInArrow(sketch, schema)


SET = ["n_shingles", "set_a", "set_b"]


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: ``node``, the set's digest, its least id, its signature."""
    grouped = (
        rows.where("n_shingles > 0")
        .groupBy(*SET)
        .agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    )
    return settled(grouped.withColumn("node", F.monotonically_increasing_id()))


def postings(nodes: DataFrame) -> DataFrame:
    """(pair, node) of each class's prefix: its rarest pairs that another class has too."""
    all_pairs = nodes.where(F.col("first_id").isNotNull()).select(
        "node", F.posexplode("signature").alias("k", "v")
    )
    tagged = F.shiftleft(F.col("k").cast("long"), 32) + F.col("v")
    all_pairs = all_pairs.select("node", tagged.alias("pair"))
    often = all_pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = all_pairs.join(often, "pair").groupBy("node").agg(F.collect_list(F.struct("n", "pair")).alias("pairs"))
    # The pairs that are a class's own come before all these and fill part of its prefix.
    length = F.size("pairs") - F.lit(COORDINATES - PREFIX)
    prefix = F.slice(F.sort_array("pairs"), F.lit(1), F.greatest(length, F.lit(0)))
    return settled(shared.select("node", F.explode(prefix).alias("p")).select("node", F.col("p.pair").alias("pair")))


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(node, set) of the ``wanted`` nodes, from the text of their first document."""
    named = nodes.join(wanted, "node", "left_semi").select("node", "first_id", *SET)
    rows = docs.select(F.col(key).cast("long").alias("first_id"), empty_text(text).alias("text"))
    rows = rows.join(named.select("first_id"), "first_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = shingle_sets(*byte_offsets(batch.column(1)), width)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            first, second = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                first[full] = np.add.reduceat(mixed(hashes), bounds[:-1][full])
                second[full] = np.bitwise_xor.reduceat(hashes, bounds[:-1][full])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                ],
                names=["first_id", *SET, "shingles"],
            )

    found = rows.mapInArrow(sets, "first_id long, n_shingles long, set_a long, set_b long, shingles array<long>")
    joined = found.join(named, ["first_id", *SET]).select("node", "shingles")
    return settled(joined.dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame | None, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures, and if given sets, are similar enough."""
    own = nodes.select(F.col("node").alias("a"), F.col("signature").alias("of_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("signature").alias("of_b"))
    agree = F.size(F.filter(F.zip_with("of_a", "of_b", lambda x, y: x == y), lambda x: x)) >= MATCHES
    if sets is not None:
        own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        agree = 100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)
    return pairs.join(own, "a").join(other, "b").where(agree).select("a", "b")


def with_component(rows: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(node))
    found = labels.select(F.col("a").alias(node), F.col("b").alias(name))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def star_pairs(posts: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """(a, b): one member of each cluster in a list, and the list's head, in a hashed order."""
    order = F.struct(F.xxhash64(F.lit(seed), "node").alias("o"), "node")
    rows = with_component(posts, labels, "node", "cluster")
    members = rows.groupBy("pair", "cluster").agg(F.min(order)["node"].alias("node"))
    heads = members.groupBy("pair").agg(F.min(order)["node"].alias("head"), F.count(F.lit(1)).alias("n"))
    met = members.join(heads.where("n > 1").drop("n"), "pair").where(F.col("node") != F.col("head"))
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def crossing_links(posts: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of different clusters in one list whose signatures agree in MATCHES places.

    In each list that holds several clusters, the members outside the largest one seek among all. Both
    sides are cut into blocks that meet in a task, where signatures are compared; only agreeing pairs
    become rows, so a frequent coordinate with many small clusters makes no rows by its square.
    """
    rows = with_component(posts, labels, "node", "cluster")
    parts = rows.groupBy("pair", "cluster").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy("pair").agg(
        F.max(F.struct("n", "cluster")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")
    )
    lists = lists.where("parts > 1").select(
        "pair",
        F.col("m.cluster").alias("largest"),
        F.ceil((F.col("all") - F.col("m.n")) / LIST_BLOCK).cast("int").alias("seekers"),
        F.ceil(F.col("all") / LIST_BLOCK).cast("int").alias("targets"),
    )
    several = rows.join(lists, "pair").withColumn("minor", F.col("cluster") != F.col("largest"))

    def spread(seeks: bool):
        own, other = ("seekers", "targets") if seeks else ("targets", "seekers")
        mine = F.pmod(F.xxhash64("node"), own).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (mine, every) if seeks else (every, mine)
        part = several.where("minor") if seeks else several
        return part.select("pair", i.alias("i"), j.alias("j"), "node", "cluster", (~F.col("minor")).alias("main"), F.lit(seeks).alias("seeks"))

    both = spread(True).unionAll(spread(False)).join(nodes.select("node", "signature"), "node")
    key = ["pair", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def found() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            node, cluster, main, seeks = (table.column(c).to_numpy() for c in ("node", "cluster", "main", "seeks"))
            signature = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            a, b = np.flatnonzero(seeks), np.flatnonzero(~seeks)
            same = np.zeros((len(a), len(b)), np.uint8)
            for k in range(COORDINATES):
                same += signature[a, k][:, None] == signature[b, k][None, :]
            once = main[b][None, :] | (node[a][:, None] < node[b][None, :])
            x, y = np.nonzero((same >= MATCHES) & once & (cluster[a][:, None] != cluster[b][None, :]))
            left, right = node[a[x]], node[b[y]]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"]
            )

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if held and tuple(keys[first]) != current:
                    yield found()
                    held = []
                current = tuple(keys[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield found()

    ordered = both.select(*key, "node", "cluster", "main", "seeks", "signature")
    ordered = ordered.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(search, "a long, b long").distinct()


def forest(nodes: np.ndarray, seeks: np.ndarray, values: np.ndarray, bounds: np.ndarray, percent: int) -> list:
    """Links (a, b) that connect whatever a seeking set is similar to; sets lie in ``values``."""
    n = len(nodes)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    length = np.diff(np.r_[start, len(ranked)])
    run = np.empty(len(values), np.int64)
    run[order] = np.repeat(np.arange(len(start)), length)
    holders = owner[order]
    group = np.arange(n)
    links = []
    for s in np.flatnonzero(seeks):
        runs = run[bounds[s] : bounds[s + 1]]
        runs = runs[length[runs] > 1]
        many = length[runs]
        at = np.repeat(start[runs] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holders[at], minlength=n)
        near = (100 * both >= percent * (size + size[s] - both)) & (group != group[s])
        for other in np.flatnonzero(near):
            if group[other] != group[s]:
                links.append((int(nodes[s]), int(nodes[other])))
                group[group == group[other]] = group[s]
    return links


def links_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) found in each (cluster, i, j); ``rows`` also hold node, seeks and shingles."""
    key = ["cluster", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def found() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("shingles").combine_chunks()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[bounds[0] : bounds[-1]]
            links = forest(
                table.column("node").to_numpy(),
                table.column("seeks").to_numpy(zero_copy_only=False),
                values,
                bounds - bounds[0],
                percent,
            )
            columns = [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                if current is not None and tuple(keys[a]) != current:
                    yield found()
                    held = []
                current = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    ordered = rows.select(*key, "node", "seeks", "shingles").repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(search, "a long, b long")


def links_in_clusters(members: DataFrame, stars: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the similar sets of each cluster, in one block or in pairs of blocks."""
    sized = members.join(nodes.select("node", "n_shingles"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = settled(sized.groupBy("cluster").agg(blocks.alias("blocks")))
    rows = members.join(sizes, "cluster")
    whole = rows.where("blocks = 1").select(
        "cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(True).alias("seeks")
    )
    large = rows.where("blocks > 1")
    links = []
    if not sizes.where("blocks > 1").isEmpty():
        # What a large cluster's star links exactly needs no search of its own.
        inside = stars.join(large.select(F.col("node").alias("a")), "a", "left_semi")
        sure = components(confirmed(inside, nodes, sets, percent))
        links.append(sure)
        named = with_component(large, sure, "node", "part")
        parts = named.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
        most = parts.groupBy("cluster").agg(
            F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("all")
        )
        seekers = F.greatest(F.ceil((F.col("all") - F.col("m.n")) / BLOCK_TEXTS), F.lit(1)).cast("int")
        cut = named.join(most.select("cluster", F.col("m.part").alias("settled"), seekers.alias("seek_blocks")), "cluster")
        target = cut.select(
            "cluster",
            F.explode(F.sequence(F.lit(0), F.col("seek_blocks") - 1)).alias("i"),
            F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("j"),
            "node",
            F.lit(False).alias("seeks"),
        )
        seeker = cut.where(F.col("part") != F.col("settled")).select(
            "cluster",
            F.pmod(F.xxhash64("node"), "seek_blocks").cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
            "node",
            F.lit(True).alias("seeks"),
        )
        both = target.unionAll(seeker).groupBy("cluster", "i", "j", "node").agg(F.max("seeks").alias("seeks"))
        whole = whole.unionAll(both)
    links.append(links_in_blocks(whole.join(sets, "node"), percent))
    return reduce(DataFrame.unionAll, links)


def linked(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text digest, n_shingles, component_id and kept."""
    rows = settled(sketches(docs, width, key, text))
    nodes = classes(rows)
    posts = postings(nodes)
    # Tables of pairs are about as long as the classes are many; so many tasks write them.
    few = max(1, math.ceil(nodes.count() / CLASSES_PER_TASK))

    def agreeing(pairs: DataFrame) -> DataFrame:
        return settled(confirmed(pairs.coalesce(few), nodes.coalesce(4 * few), None, percent).coalesce(few))

    stars = agreeing(star_pairs(posts, None, 1))
    labels = components(stars)
    again = agreeing(star_pairs(posts, labels, 2))
    labels = components(labels.unionAll(again))
    released(docs.sparkSession)
    between = settled(crossing_links(posts, labels, nodes).coalesce(few))
    heads = labels.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct()
    members = labels.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionAll(heads)
    ends = between.select(F.col("a").alias("node")).unionAll(between.select("b"))
    sets = sets_of(docs, nodes, members.select("node").unionAll(ends).distinct(), width, key, text)
    inside = links_in_clusters(members, stars.unionAll(again), nodes, sets, percent)
    links = settled(inside.unionAll(confirmed(between, nodes, sets, percent)).coalesce(few))
    released(docs.sparkSession)
    found = components(links)
    named = with_component(nodes.select("node", "first_id", *SET), found, "node", "component")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(names, "component").select(*SET, "component_id")
    out = rows.drop("signature").join(of_set, SET, "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "_text_a", "_text_b", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are their component's document, repeated rows once."""
    names = {n: prefixed(docs.columns, n) for n in digest(text)}
    gone = linked(docs, width, percent, key, text).where("not kept").select("doc_id", *digest(text)).distinct()
    gone = gone.withColumnsRenamed(names | {"doc_id": "_gone_id"})
    marked = docs.withColumns({names[n]: c for n, c in digest(text).items()})
    own = [marked[c] == gone[c] for c in names.values()]
    left = marked.join(gone, [marked[key].eqNullSafe(gone["_gone_id"]), *own], "left_anti")
    return left.dropDuplicates([key, *names.values()]).select(*docs.columns)
