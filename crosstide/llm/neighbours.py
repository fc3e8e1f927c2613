"""Approximate nearest neighbours by inner product with cross-polytope hashing.

A table turns vectors by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform) and puts each into the cell of the signed axis it is
nearest to. Vectors of unequal length get one more coordinate first, which
makes all of them equally long and keeps the order of inner products; queries
have a zero there. A query probes the cells of its PROBES nearest signed axes in
each of TABLES tables, and more of them while they hold fewer than LEAST
vectors. What lies in a probed cell is reranked by the exact inner product.

Rows are hashed once and keep their cells of all tables. They are dealt by id into
blocks of vectors and blocks of queries, however many of them share a cell; a block of
vectors meets each block of queries once, with all tables, so a vector moves as often
as there are blocks of queries and a pair that several tables propose is one row. Only
the counts of the cells, 2 * AXES for each table, come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from crosstide.llm.common import discard, let_go, materialize, mix, small_batches

TABLES, PROBES, AXES = 16, 6, 64
LEAST = 64
VECTORS, QUERIES = 3 << 15, 1 << 16  # of a block at most
BLOCK_BYTES = 1 << 25  # of the vectors, or of the queries, of a block
AT_ONCE, PRODUCTS, CHOSEN = 1 << 14, 1 << 21, 1 << 20  # queries, products and chosen pairs worked on at a time


def takes_part(column: str) -> Column:
    """Vectors without nulls or values that are not finite, and not all zero."""
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(values, lambda x: x != 0), F.lit(False))


def rotate(vectors: np.ndarray, table: int) -> np.ndarray:
    """The first AXES coordinates of the table's pseudo-rotation."""
    n, size = vectors.shape
    signs = np.random.default_rng([table, size]).choice((-1.0, 1.0), (3, size))
    out = vectors
    for s in signs:
        out = out * s
        step = 1
        while step < size:
            out = out.reshape(n, size // (2 * step), 2, step)  # also without rows
            out = np.concatenate([out[:, :, :1] + out[:, :, 1:], out[:, :, :1] - out[:, :, 1:]], 2).reshape(n, size)
            step *= 2
        out = out / math.sqrt(size)
    return out[:, :AXES]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), size))
    out[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def lifted(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors on one sphere, with a power of two coordinates."""
    n, size = vectors.shape
    out = np.zeros((n, 1 << max(int(size).bit_length(), AXES.bit_length() - 1)))
    squares = (vectors / longest) ** 2
    out[:, :size] = vectors / longest
    if query:
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
    else:
        out[:, size] = np.sqrt(np.maximum(1 - squares.sum(1), 0))
    return out


def turns(size: int) -> np.ndarray:
    """The pseudo-rotations of all tables, side by side, for the coordinates that ``lifted`` fills."""
    unit = np.eye(size + 1, 1 << max(int(size).bit_length(), AXES.bit_length() - 1))
    return np.concatenate([rotate(unit, t) for t in range(TABLES)], 1)


def turned(vectors: np.ndarray, longest: float, query: bool, turn: np.ndarray) -> np.ndarray:
    """Nearness to the signed axes of each table: axis for +, AXES + axis for -."""
    out = (lifted(vectors, longest, query)[:, : len(turn)] @ turn).reshape(len(vectors), TABLES, AXES)
    return np.concatenate([out, -out], 2)


def _as_bytes(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _from_bytes(column, kind: str) -> np.ndarray:
    """Rows of values from their bytes, equally many in each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def _hash(size: int, longest: float, kind: str):
    """Rows (vec_id, embedding, asked) to rows (vec_id, asked, vector, cells)."""

    def run(batches):
        turn = turns(size)
        for batch in batches:
            vectors = matrix(batch.column(1), size)
            cells = turned(vectors, longest, False, turn).argmax(2).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _as_bytes(vectors.astype(kind)), _as_bytes(cells)], names=["vec_id", "asked", "vector", "cells"])

    return run


def _count(batches):
    total = np.zeros((TABLES, 2 * AXES), np.int64)
    for batch in batches:
        cells = _from_bytes(batch.column(0), "u1")
        for t in range(TABLES if len(cells) else 0):
            total[t] += np.bincount(cells[:, t], minlength=2 * AXES)
    t, cell = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"t": t, "cell": cell, "rows": total[t, cell]})


def probed(queries: np.ndarray, longest: float, turn: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each query asks each cell of each table."""
    nearness = turned(queries, longest, True, turn)
    order = np.argsort(-nearness, axis=2, kind="stable")
    held = np.cumsum(np.take_along_axis(np.broadcast_to(counts, order.shape), order, 2), axis=2)
    wanted = np.maximum(PROBES, (held < LEAST).sum(2) + 1)
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, np.arange(2 * AXES) < wanted[:, :, None], 2)
    return out


def _place(size: int, longest: float, kind: str, counts: np.ndarray, vector_parts: int, query_parts: int):
    """Rows (vec_id, asked, vector, cells) to rows (block, side, vec_id, vector, cells); cells of a query are those it asks, as bits."""

    def run(batches):
        turn = turns(size)
        for batch in batches:
            ids, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            spread = mix(ids.astype(np.uint64))
            own, place = (spread % np.uint64(vector_parts)).astype(np.int64), (spread // np.uint64(vector_parts) % np.uint64(query_parts)).astype(np.int64)

            def rows(block, side, of):
                return pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), side)), *of], names=["block", "side", "vec_id", "vector", "cells"])

            for q in range(query_parts):
                yield rows(own * query_parts + q, 0, [batch.column(0), batch.column(2), batch.column(3)])
            if asked.any():
                some = batch.filter(pa.array(asked))
                asks = probed(_from_bytes(some.column(2), kind).astype(float), longest, turn, counts)
                bits = _as_bytes(np.packbits(asks.reshape(len(asks), -1), axis=1))
                for v in range(vector_parts):
                    yield rows(v * query_parts + place[asked], 1, [some.column(0), some.column(2), bits])

    return run


def _scaled(rows: np.ndarray, by, share: float) -> np.ndarray:
    """Rows over ``by`` in single precision, and their length times ``share`` as one more coordinate."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.float32)
    for at in range(0, len(rows), 1 << 13):
        part = slice(at, at + (1 << 13))
        values = np.divide(rows[part], by if np.ndim(by) == 0 else by[part, None], dtype=float)
        out[part, :-1], out[part, -1] = values, share * np.linalg.norm(values, axis=1)
    return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, asks: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int):
    """Each query's ``k`` best rows in the cells it asks: (query_id, vec_id, score), ties to the smaller id.

    Products in single precision, raised by what they can be wrong by, only choose
    the rows that may be among the best so far; scores are summed row by row in double
    precision, so that equal vectors have equal scores. Of equal vectors in the same
    cells only the ``k + 1`` smallest ids can be among the ``k`` best, one being the query.
    """
    size, slack = vectors.shape[1], (vectors.shape[1] + 16) * 2.0**-23
    whole = np.concatenate([np.ascontiguousarray(vectors).view("u1"), cells], 1)
    value = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    del whole
    order = np.lexsort((ids, value))
    kept = order[np.arange(len(order)) - np.searchsorted(value[order], value[order]) <= k]
    kept = kept[np.argsort(ids[kept])]
    vectors, ids, cells = vectors[kept], ids[kept], cells[kept]
    most = np.abs(vectors).max().astype(float)
    raised = _scaled(vectors, most, slack)
    raised[:, size] += 1e-36
    margins = raised[:, size]
    by_cell = [np.argsort(cells[:, t], kind="stable") for t in range(TABLES)]
    cuts = [np.searchsorted(cells[by_cell[t], t], np.arange(2 * AXES + 1)) for t in range(TABLES)]
    found = []
    for first in range(0, len(queries), AT_ONCE):
        some, some_ids = queries[first : first + AT_ONCE], query_ids[first : first + AT_ONCE]
        largest = np.abs(some).max(1).astype(float)
        probes = _scaled(some, largest, 1.0)
        floor = np.full(len(some), -np.inf, np.float32)
        best = (np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0))  # query, row, score
        chosen, n = [], 0
        for t in range(TABLES):
            bits = np.unpackbits(asks[first : first + AT_ONCE, t * 2 * AXES // 8 : (t + 1) * 2 * AXES // 8], axis=1).astype(bool)
            for c in range(2 * AXES):
                held, asking = by_cell[t][cuts[t][c] : cuts[t][c + 1]], np.flatnonzero(bits[:, c])
                near = raised[held] if len(asking) else None
                step = max(1, PRODUCTS // max(1, len(held)))
                for at in range(0, len(asking) if len(held) else 0, step):
                    a = asking[at : at + step]
                    bounds, limit = probes[a] @ near.T, floor[a]
                    fresh = np.flatnonzero(limit == -np.inf)
                    if len(fresh) and len(held) > k + 1:  # the k + 1 best of these rows, the query itself may be one
                        low = bounds[fresh] - 2 * probes[a[fresh], size :] * margins[held]
                        limit[fresh] = np.partition(low, len(held) - k - 1, axis=1)[:, len(held) - k - 1]
                        floor[a[fresh]] = limit[fresh]
                    i, j = np.divmod(np.flatnonzero(bounds >= limit[:, None]), len(held))
                    chosen.append((a[i].astype(np.uint16), held[j]))
                    n += len(i)
                    if n > CHOSEN:
                        best = _merged(best, chosen, some, some_ids, vectors, ids, k)
                        chosen, n = [], 0
            if (t + 1) & t and t + 1 < TABLES:  # what is found is put together after 1, 2, 4, ... tables
                continue
            if chosen:
                best = _merged(best, chosen, some, some_ids, vectors, ids, k)
                chosen, n = [], 0
            q, _, score = best
            full = np.flatnonzero(np.bincount(q, minlength=len(some)) == k)
            least = score[np.searchsorted(q, full, side="right") - 1] / largest[full] / most
            floor[full] = np.maximum(floor[full], np.nextafter((least - 1e-12 * np.abs(least)).astype(np.float32), np.float32(-np.inf)))
        found.append((some_ids[best[0]], ids[best[1]], best[2]))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _merged(best, chosen, queries, query_ids, vectors, ids, k: int):
    """The ``k`` best of each query out of those before and the chosen pairs, by query, best first; rows go by id."""
    q, row = (np.concatenate(x) for x in zip(*chosen, strict=True))
    other = ids[row] != query_ids[q]
    q, row = q[other], row[other]
    score = np.zeros(len(q))
    for at in range(0, len(q), 1 << 13):
        part = slice(at, at + (1 << 13))
        score[part] = (vectors[row[part]].astype(float) * queries[q[part]].astype(float)).sum(1)
    q, row, score = (np.concatenate(x) for x in zip(best, (q, row, score), strict=True))
    order = np.lexsort((row, -score))
    order = order[np.argsort(q[order], kind="stable")]
    q, row, score = q[order], row[order], score[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (row[1:] != row[:-1])]) if len(q) else np.zeros(0, bool)
    q, row, score = q[new], row[new], score[new]
    nth = np.arange(len(q)) - np.searchsorted(q, np.arange(len(queries), dtype=q.dtype))[q]
    return q[nth < k], row[nth < k], score[nth < k]


def _rerank(k: int, kind: str):
    def run(table):
        side, ids = table["side"].to_numpy(), table["vec_id"].to_numpy()
        asking, held = table.filter(pa.array(side == 1)), table.filter(pa.array(side == 0))
        if not len(asking) or not len(held):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query_id, vec_id, score = nearest(
            _from_bytes(asking["vector"], kind), ids[side == 1], _from_bytes(asking["cells"], "u1"),
            _from_bytes(held["vector"], kind), ids[side == 0], _from_bytes(held["cells"], "u1"), k,
        )
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})

    return run


def search(vectors: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` for which ``asked`` holds.

    query_id, rank (from 1), vec_id, score: the inner product in double
    precision, largest first, ties to the smaller id, without the query's own
    id. Vectors that are null, zero or hold values that are null or not finite
    take no part, nor do rows without an id; rows that repeat an id are one
    vector, the largest. Shorter vectors are taken to end in zeros. An empty
    table, or one without queries, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind, element = ("f4", "float") if single else ("f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), asked.alias("asked"))
    rows = rows.where(takes_part("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.max("embedding").alias("embedding"), F.max("asked").alias("asked"))
    rows = materialize(rows, "vectors")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size, longest, n, n_asked = rows.agg(F.max(F.size("embedding")), F.max(squares), F.count(F.lit(1)), F.count_if("asked")).first()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = math.sqrt(longest)
    hashed = materialize(rows.mapInArrow(_hash(size, longest, kind), "vec_id long, asked boolean, vector binary, cells binary"), "hashed-vectors")
    discard(rows)
    counts = np.zeros((TABLES, 2 * AXES), np.int64)
    counted = hashed.select("cells").mapInArrow(_count, "t long, cell long, rows long")
    for t, cell, held in counted.groupBy("t", "cell").agg(F.sum("rows")).collect():
        counts[t, cell] = held
    let_go(spark)
    in_block = max(1, BLOCK_BYTES // (size * int(kind[1])))
    vector_parts = max(-(-n // min(VECTORS, in_block)), min(-(-n // 2048), 2 * spark.sparkContext.defaultParallelism))
    query_parts = -(-n_asked // min(QUERIES, in_block))
    place = _place(size, longest, kind, counts, vector_parts, query_parts)
    placed = hashed.mapInArrow(place, "block long, side long, vec_id long, vector binary, cells binary")
    found = placed.groupBy("block").applyInArrow(_rerank(k, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
