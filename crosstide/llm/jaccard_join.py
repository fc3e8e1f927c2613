"""N-gram Jaccard join with count vectors in an R-tree.

Tokens (hashes of five-word runs) are hashed into groups. The counts of a set
in its groups are the set's point; the sum of coordinate minima of two points
is never below the sets' overlap, nor that of the upper corners of two boxes
below the overlap of any pair inside them. So a box or a point whose bound is
below the overlap that the similarity needs is left out without loss, and what
survives is verified on the whole sets.

Points meet in cells. A set of more than ``WHOLE`` tokens is cut into about one
group for every two to four tokens, the same number of groups for all sets of a
size band, and enters the cells of ``CELLS`` of its groups: a cell is a group
with equal content. Sets near the upper end of a band also enter the cells of
the next, so every linked pair meets in a common band. A linked pair differs in
at most a ninth of its tokens, so each of its groups agrees with a chance above
0.4 whatever the texts are, and the chance that none of 40 agrees is below 2e-9 (0.6^40).
A set of at most 1.25 * WHOLE tokens enters one cell for each token of its
smallest n - ceil(0.8 n) + 1 hashes; two linked sets always share one of these.

1. Documents with the same set are one node, named by its smallest id.
2. In each cell the most central node leads: the one whose cells hold the most
   nodes in all, as the text has that others were copied from. A node is verified
   against the leader it meets most often, after the bound of their points. A
   large group of near copies costs one comparison for each copy, not one for
   each pair, whatever the ids are.
3. In cells where nodes of more than one component remain, an R-tree over the
   points joins each with the nodes of other components; cells of any size are
   dealt out in blocks of ``BLOCK`` points, all pairs of blocks included.
   Survivors are verified, and components are closed over both kinds of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, discard, materialize, mix, shingle_sets, signed, small_batches

WHOLE = 64  # sets up to this size are routed by single tokens
CELLS = 40  # groups of a larger set that route it
DIMS = 256  # coordinates of a point
BLOCK = 2048  # points of one cell in one task
LEAF = 32  # points in a leaf of the R-tree


def needed(a, b, percent: int = 80):
    """Smallest overlap with which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def routes(tokens: np.ndarray, percent: int = 80) -> np.ndarray:
    """Cells of one set (sorted distinct hashes)."""
    n, most = len(tokens), math.floor(WHOLE * 100 / percent)
    found = []
    if 0 < n <= most:
        found.append(mix(tokens[: n - math.ceil(n * percent / 100) + 1]))
    if n > WHOLE:
        band = int(math.log2(n / WHOLE) if n > WHOLE else 0)
        while WHOLE << band > n:
            band -= 1
        while WHOLE << (band + 1) <= n:
            band += 1
        bands = [band] + [band + 1] * (n * 100 / percent >= WHOLE << (band + 1))
        for b in bands:
            groups = (WHOLE << b) // 2
            salt = np.uint64(0x51ED270B * (b + 1))
            mixed = mix(tokens ^ salt)
            group = mixed % np.uint64(groups)
            keep = group < CELLS
            content, group = mix(mixed[keep] + salt), group[keep].astype(np.int64)
            sums, counts = np.zeros(CELLS, np.uint64), np.bincount(group, minlength=CELLS)
            np.add.at(sums, group, content)
            used = np.flatnonzero(counts)
            label = used.astype(np.uint64) + np.uint64(CELLS * (b + 1))
            found.append(mix(sums[used] + mix(label) + counts[used].astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def point(tokens: np.ndarray) -> bytes:
    """Counts of the set in DIMS groups; two bytes each, four if a count needs them."""
    counts = np.bincount((mix(tokens ^ np.uint64(0xA5A5)) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def counts_of(points: list[bytes]) -> np.ndarray:
    """One row of DIMS counts for each point."""
    if all(len(p) == 2 * DIMS for p in points):
        return np.frombuffer(b"".join(points), "<u2").reshape(-1, DIMS)
    return np.stack([np.frombuffer(p, "<u2" if len(p) == 2 * DIMS else "<u4").astype(np.uint32) for p in points])


def survivors(points: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, percent: int = 80):
    """Index pairs whose bound reaches the needed overlap, by a packed R-tree over ``others``.

    Leaves hold LEAF points that follow each other by size and first
    coordinates; a node above has the upper corner of what lies below it and its
    smallest and largest size. The other side comes in leaves of the same kind,
    each of which goes down the tree as one box.
    """
    order = np.lexsort((others[:, 1], others[:, 0], other_sizes))
    own = np.lexsort((points[:, 1], points[:, 0], sizes))
    levels = []
    top, low, high = others[order], other_sizes[order], other_sizes[order]
    while not levels or len(top) > 1:
        cuts = np.arange(0, len(top), LEAF)
        top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
        levels.append((top, low, high))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(own), LEAF):
        leaf = own[at : at + LEAF]
        corner, least, most = points[leaf].max(0), sizes[leaf].min(), sizes[leaf].max()
        nodes = np.zeros(1, np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            top, low, high = levels[depth]
            fits = (low[nodes] * percent <= 100 * most) & (high[nodes] * 100 >= percent * least)
            fits &= np.minimum(top[nodes], corner).sum(1, dtype=np.int64) >= needed(least, low[nodes], percent)
            below = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = below[below < (len(levels[depth - 1][0]) if depth else len(order))]
        for cut in range(0, len(nodes), 16 * LEAF):
            near = order[nodes[cut : cut + 16 * LEAF]]
            bound = np.minimum(points[leaf][:, None, :], others[near][None, :, :]).sum(2, dtype=np.int64)
            a, b = np.nonzero(bound >= needed(sizes[leaf][:, None], other_sizes[near][None, :], percent))
            found_a.append(leaf[a])
            found_b.append(near[b])
    return np.concatenate(found_a), np.concatenate(found_b)


def _describe(percent: int, k: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            folds = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64)
            prints = mix(mix(sums) + folds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed(prints)),
                    pa.array([signed(routes(s, percent)) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "print", "cells"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([signed(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([point(s) for s in sets], pa.binary()),
                ],
                names=["node", "tokens", "point"],
            )

    return run


def _verify(percent: int):
    """Rows (a, b, tokens, point, other tokens, other point) to the linked (a, b)."""

    def run(batches):
        for batch in batches:
            one, other = batch.column(2), batch.column(4)
            p, q = batch.column(3), batch.column(5)
            keep = []
            for i in range(len(batch)):
                x, y = one[i].values, other[i].values
                n, m = len(x), len(y)
                need = needed(n, m, percent)
                fits = min(n, m) >= need
                if fits:
                    fits = int(counts_of([p[i].as_py(), q[i].as_py()]).min(0).sum(dtype=np.int64)) >= need
                if fits:
                    fits = len(np.intersect1d(x.to_numpy(), y.to_numpy(), assume_unique=True)) >= need
                keep.append(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"]
            )

    return run


def _tree_join(percent: int):
    """Some blocks of rows (block, side, node, component, point) to surviving pairs."""

    def run(table):
        table = table.sort_by("block")
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        component, side = table["component"].to_numpy(), table["side"].to_numpy()
        points = counts_of(table["point"].to_pylist())
        sizes = points.sum(1, dtype=np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            rows = np.arange(begin, end)
            left, right = rows[side[rows] != 2], rows[side[rows] != 1]
            if len(left) and len(right):
                a, b = survivors(points[left], sizes[left], points[right], sizes[right], percent)
                a, b = left[a], right[b]
                keep = (component[a] != component[b]) & ((side[a] != 0) | (node[a] < node[b]))
                pairs.append(np.stack([node[a[keep]], node[b[keep]]], 1))
        found = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b).

    Every node points at its smallest neighbour and then at that one's label,
    with both ends of each link carried over to the labels until all agree.
    Labels only go down, so they have settled when their sum stays as it is.
    No side of a join is sent through the driver, whatever its size.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while True:
        # the label of the label, then the smallest label in the neighbourhood
        hop = labels.join(dealt(labels.select(F.col("node").alias("component"), F.col("component").alias("far"))), "component", "left").select(
            "node", F.least("component", F.coalesce("far", "component")).alias("component")
        )
        near = both.join(dealt(hop.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooks = hop.join(dealt(near), "node").select(F.col("component").alias("node"), F.col("near").alias("component")).where("component < node")
        following = hop.union(near).union(hooks).groupBy("node").agg(F.min("component").alias("component"))
        labels = materialize(following, "labels")
        after = labels.agg(total).first()[0]
        if after == before:
            return labels
        before = after


def similar_documents(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    A set is the distinct ``k``-word shingles of the whole text, A-Z lowered;
    with fewer words the whole sequence is one shingle. Sets link when 100 *
    intersection >= percent * union. Texts that are null, empty or without
    words have no shingles and are alone. Rows that repeat an id are one
    document. A row without an id has a null component. Columns other than
    doc_id and text are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.mapInArrow(_describe(percent, k), "doc_id long, n long, print long, cells array<long>"), "sets")
    # written first, so that the join below can split a large group of copies
    classes = materialize(rows.where("n > 0").groupBy("print", "n").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    member = materialize(rows.select("doc_id", "n", "print").join(dealt(classes), ["print", "n"], "left"), "members")
    heads = member.where("doc_id = node").select("node").distinct()

    post = rows.where("n > 0").join(dealt(heads), F.col("doc_id") == F.col("node"), "left_semi").select(F.explode("cells").alias("cell"), F.col("doc_id").alias("node"))
    shared = post.groupBy("cell").agg(F.count("*").alias("held"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    met = materialize(post.join(dealt(materialize(shared.select("cell", "held"), "shared")), "cell"), "cells")
    discard(rows)
    central = materialize(met.groupBy("node").agg(F.sum("held").alias("weight")), "weights")
    lead = met.join(dealt(central), "node").groupBy("cell").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    chosen = (
        met.join(dealt(materialize(lead, "lead")), "cell")
        .where("node <> leader")
        .groupBy("node", "leader")
        .count()
        .groupBy("node")
        .agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    )
    chosen = materialize(chosen, "leaders")
    tried = chosen.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    busy = chosen.select("node").union(chosen.select("leader")).distinct()
    sets = texts.join(dealt(busy), F.col("doc_id") == F.col("node"), "left_semi").distinct().mapInArrow(_sets(k), "node long, tokens array<long>, point binary")
    sets = materialize(sets, "tokens")
    links = materialize(verified(tried, sets, percent), "links")
    labels = components(links)

    # cells that still hold more than one component
    named = met.select("cell", "node").join(dealt(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).where("low < high")
    named = materialize(named.join(dealt(mixed.select("cell", "rows")), "cell"), "mixed")
    pairs = materialize(remaining(named, sets.select("node", "point"), percent), "pairs")
    more = verified(pairs.join(tried, ["a", "b"], "left_anti"), sets, percent)
    labels = components(links.union(more))
    out = member.join(dealt(labels), "node", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"), F.col("point").alias("point_a"))
    other = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"), F.col("point").alias("point_b"))
    full = dealt(dealt(pairs).join(one, "a")).join(other, "b").select("a", "b", "tokens_a", "point_a", "tokens_b", "point_b")
    return full.mapInArrow(_verify(percent), "a long, b long")


def remaining(named: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components whose points agree well enough in some cell.

    The nodes of a cell are dealt into parts of about BLOCK; every pair of parts
    is one block, with side 0 for a part against itself, 1 and 2 otherwise. A
    task call takes blocks of about 4 * BLOCK rows in all.
    """
    spread = named.withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int"))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(dealt(points), "node")
    placed = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = F.least("part", "other"), F.greatest("part", "other")
    placed = placed.select(
        F.xxhash64("cell", x, y).alias("block"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
        "node",
        "component",
        "point",
    )
    total = named.agg(F.sum(F.ceil(F.col("rows") / BLOCK))).first()[0] or 0
    placed = placed.groupBy(F.pmod("block", F.lit(max(16, total // (4 * BLOCK)))).alias("call"))
    return placed.applyInArrow(_tree_join(percent), "a long, b long").distinct()
