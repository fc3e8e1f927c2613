"""Conversation structure repair by a cost DP and prefix-doubling path ranking.

A conversation is repaired when the initials of its roles are ``(s?(ua)+)?``.
Rows are kept (K), given the role user or assistant (R, cost 2) or deleted (D,
cost 3, the only way for blank and duplicate rows); rows without a text are
inserted (I, cost 2); a truncated row that stays costs 1.

The state is what the roles so far allow next: S at the start, P after a system
row, U after a user row, A after an assistant row. A node is (row, state), an
edit is an arc, and what any edit leads to follows from state and row.

1. Conversations are sorted by range over all tasks and cut into segments of at
   most ``ROWS`` rows, numbered throughout; a conversation is a run of segments,
   so none has to fit into a task.
2. Cost DP: a segment is a 4 x 4 matrix of least costs between states. Products
   up to the end of a conversation come from doubling over segments (1, 2, 4,
   ...), and give the cost still to come at the end of each segment.
3. Path ranking: with these costs known, the arcs on cheapest ways are known.
   Nodes are ranked by the first 1, 2, 4, ... edits of their least way: the rank
   of twice the length is that of the pair (own rank, rank of the node that the
   doubled pointer reaches). No two arcs of a node bear the same edit, so each
   length has one pointer. The least way then is read from the doubled pointers,
   2^k edits at once.
4. The state in which a way enters a segment comes from doubling over the
   segments' maps of states; each segment writes its edits and rows, and these
   are put together in order of segments.

Rows that are alike in all columns are folded into one with a count before they
are shuffled; all but the first are duplicates, hence deleted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, discard, materialize, small_batches

ROWS = 256  # rows of a segment
BYTES = 4 << 20  # bytes of text of a segment; one longer text is a segment of its own
NEVER = 1 << 40
S, P, U, A = range(4)
AFTER = {"u": {S: U, P: U, A: U}, "a": {U: A}, "s": {S: P}}  # state after a row with this initial
NEXT = np.array([U, U, A, U])  # state after the row that can be inserted or given a role
ROLE = {U: "user", A: "assistant"}  # of a row that leads to the state
END = np.array([0, 4, 2, 0])  # cost of the inserts that end a conversation
EDITS = "DIKR"  # in the order in which ties are broken
_INSERTS = np.array([[0, NEVER, 2, 4], [NEVER, 0, 2, 4], [NEVER, NEVER, 0, 2], [NEVER, NEVER, 2, 0]])
_KEEP = {k: np.array([AFTER.get(k, {}).get(s, -1) for s in range(4)]) for k in ("u", "a", "s", "")}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_INK = r"[^\x20\x09-\x0D]"

SEGMENT = "conv_id long, task int, number long, initials array<string>, faults array<int>, copies array<long>, roles array<string>, texts array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows folded and damaged; a dropped row has no copies.

    A null role or text is one space, and so is a null id or turn where the
    damage is drawn from ``conv_id:turn``.
    """
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, F.col("copies") * 2).otherwise(F.col("copies")).cast("long").alias("copies"),
    )
    # rows that differed only in what the damage took away are alike now
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``, the first fault of their first copy (0: none)."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.groupBy("conv_id", "role", "text").agg(F.min(place).alias("place"), F.count("*").alias("places")).where("places > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "place")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    joined = rows.join(dealt(again), same, "left")
    repeated = F.col("place").isNotNull() & ~place.eqNullSafe(F.col("place"))
    fault = F.when(~F.col("text").rlike(_INK), BLANK).when(repeated, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _cut(batches):
    """Sorted rows (conv_id, role, text, copies, fault) to segments, numbered within the task."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def segment():
        columns = list(zip(*held, strict=True))
        values = [[held[0][0]], [task], [number], [[r[:1] for r in columns[1]]], [columns[4]], [columns[3]], [columns[1]], [columns[2]]]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["conv_id", "task", "number", "initials", "faults", "copies", "roles", "texts"]
        return pa.RecordBatch.from_arrays([pa.array([list(v[0])] if isinstance(v[0], tuple) else v, t) for v, t in zip(values, types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) == ROWS or size > BYTES):
                yield segment()
                number, held, size = number + 1, [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield segment()


class Graph:
    """Arcs of a batch of segments: node (segment, row, state) by edit."""

    def __init__(self, initials: list, faults: list, copies: list, last: np.ndarray):
        self.n, self.rows = len(initials), np.array([len(x) for x in initials], np.int64)
        self.longest = int(self.rows.max(initial=0))
        shape = (self.n, self.longest)
        self.real = np.arange(self.longest) < self.rows[:, None]
        fault, kept, extra = np.zeros(shape, np.int64), np.full((*shape, 4), -1), np.zeros(shape, np.int64)
        fault[self.real] = [x for f in faults for x in f]
        extra[self.real] = [3 * (x - 1) for c in copies for x in c]
        kept[self.real] = np.array([_KEEP.get(x, _KEEP[""]) for f in initials for x in f]).reshape(-1, 4)
        self.bad, self.late, self.extra = (fault == BLANK) | (fault == DUPLICATE), (fault == TRUNCATED).astype(np.int64), extra
        self.kept = np.where(self.bad[..., None], -1, kept)
        self.last = last

    def step(self, r: int, ahead: np.ndarray) -> np.ndarray:
        """Least cost from the states before row ``r`` (inserts come first), given those after it: (n, 4, ...)."""
        best = ahead + 3
        late = self.late[:, r].reshape(-1, *[1] * (ahead.ndim - 2))
        for s in range(4):
            target = self.kept[:, r, s]
            keep = np.where((target >= 0).reshape(late.shape), ahead[np.arange(self.n), np.maximum(target, 0)] + late, NEVER)
            rerole = np.where(self.bad[:, r].reshape(late.shape), NEVER, ahead[:, NEXT[s]] + 2 + late)
            best[:, s] = np.minimum(best[:, s], np.minimum(keep, rerole))
        best = best + self.extra[:, r].reshape(-1, *[1] * (ahead.ndim - 1))
        through = (_INSERTS[None, :, :, *[None] * (ahead.ndim - 2)] + best[:, None]).min(2)
        real = self.real[:, r].reshape(-1, *[1] * (ahead.ndim - 1))
        return np.where(real, np.minimum(through, NEVER), ahead)

    def matrices(self) -> np.ndarray:
        """Least costs (n, 4, 4) from the states before the first row to those after the last."""
        costs = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (self.n, 4, 4)).astype(np.int64)
        for r in range(self.longest - 1, -1, -1):
            costs = self.step(r, costs)
        return costs

    def solve(self, ahead: np.ndarray) -> None:
        """Costs to come at each node, then arcs on cheapest ways, ranks and doubled pointers."""
        costs = np.zeros((self.n, self.longest + 1, 4), np.int64)
        costs[:, self.longest] = ahead
        for r in range(self.longest - 1, -1, -1):
            costs[:, r] = self.step(r, costs[:, r + 1])
        self.costs = costs
        ids = np.arange(costs.size).reshape(costs.shape)
        edit = np.full(costs.shape, len(EDITS))
        target = ids.copy()

        def offer(k, at, to, cost):
            better = (k < edit[at]) & (cost == costs[at]) & (cost < NEVER)
            edit[at] = np.where(better, k, edit[at])
            target[at] = np.where(better, to, target[at])

        for s in range(4):
            before, after = np.s_[:, :-1, s], costs[:, 1:, :]
            offer(0, before, ids[:, 1:, s], np.where(self.real, after[:, :, s] + 3 + self.extra, NEVER))
            inserts = costs[:, :, NEXT[s]] + 2
            inserts[:, :-1][~self.real] = NEVER
            inserts[:, -1][~self.last] = NEVER
            offer(1, np.s_[:, :, s], ids[:, :, NEXT[s]], inserts)
            to = np.maximum(self.kept[:, :, s], 0)
            kept = np.take_along_axis(after, to[..., None], 2)[..., 0] + self.late + self.extra
            offer(2, before, np.take_along_axis(ids[:, 1:, :], to[..., None], 2)[..., 0], np.where(self.real & (self.kept[:, :, s] >= 0), kept, NEVER))
            offer(3, before, ids[:, 1:, NEXT[s]], np.where(self.real & ~self.bad, after[:, :, NEXT[s]] + 2 + self.late + self.extra, NEVER))
        self.edit, self.ids = edit.ravel(), ids
        pointer, rank = target.ravel(), (self.edit + 1) % (len(EDITS) + 1)
        segment, level = pointer // (4 * (self.longest + 1)), pointer // 4 % (self.longest + 1)
        past = level >= self.rows[segment]  # behind the last row of a short segment is its end
        pointer = np.where(past, ids[segment, self.longest, pointer % 4], pointer)
        self.pointers = [pointer]
        while True:
            pair = rank * (rank.max(initial=0) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1]
            doubled = pointer[pointer]
            if (doubled == pointer).all():
                break
            pointer = doubled
            self.pointers.append(pointer)
        self.rank = rank

    def exits(self) -> np.ndarray:
        """State (n, 4) after the segment for each state before it."""
        return self.pointers[-1][self.ids[:, 0, :]] % 4

    def ways(self, entry: np.ndarray) -> np.ndarray:
        """Nodes of the least way of each segment from its state of entry, read 1, 2, 4, ... at once."""
        way = self.ids[np.arange(self.n), 0, entry][:, None]
        for pointer in self.pointers:
            way = np.concatenate([way, pointer[way]], 1)
        return way


def _matrices(batches):
    for batch in batches:
        graph = Graph(*(batch.column(k).to_pylist() for k in (1, 2, 3)), np.zeros(len(batch), bool))
        costs = graph.matrices().reshape(len(batch), 16)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(costs), pa.list_(pa.int64()))], names=["seg", "costs"])


def _solved(batch) -> tuple[Graph, list]:
    """Graph of rows (…, initials, faults, copies, ahead), ahead being null at the end of a conversation."""
    columns = {name: batch.column(name).to_pylist() for name in ("initials", "faults", "copies", "ahead")}
    ahead = np.array([END if x is None else x for x in columns["ahead"]], np.int64).reshape(-1, 4)
    graph = Graph(columns["initials"], columns["faults"], columns["copies"], np.array([x is None for x in columns["ahead"]], bool))
    graph.solve(ahead)
    return graph, ahead


def _exits(batches):
    for batch in batches:
        graph, _ = _solved(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(graph.exits().astype(np.int32)), pa.list_(pa.int32()))], names=["seg", "exits"])


def _repaired(batches):
    """Segments with ahead and entry to (conv_id, seg, audit, lines, body, cost, counts of faults, initials at both ends)."""
    for batch in batches:
        graph, ahead = _solved(batch)
        entry = np.array(batch.column("entry").to_pylist(), np.int64)
        ways = graph.ways(entry)
        ends = ways[:, -1] % 4
        at = np.arange(len(batch))
        cost = graph.costs[at, 0, entry] - np.where(graph.last, 0, ahead[at, ends])
        out: list[tuple] = []
        columns = (batch.column(name).to_pylist() for name in ("conv_id", "seg", "initials", "faults", "copies", "roles", "texts"))
        for i, (conv, seg, initials, faults, copies, roles, texts) in enumerate(zip(*columns, strict=True)):
            audit, lines, states = [], [], ways[i] % 4
            for k, node in enumerate(ways[i]):
                kind = graph.edit[node]
                if kind == len(EDITS):
                    continue
                r = node // 4 % (graph.longest + 1)
                audit.append(EDITS[kind])
                if EDITS[kind] == "I":
                    lines.append(f"{ROLE[NEXT[states[k]]]}:")
                    continue
                audit.append("D" * (copies[r] - 1))
                if EDITS[kind] != "D":
                    lines.append(f"{roles[r] if EDITS[kind] == 'K' else ROLE[NEXT[states[k]]]}:{texts[r]}")
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            counts = [sum(c for c, f in zip(copies, faults, strict=True) if f == BLANK)]
            counts.append(sum(c - (f != DUPLICATE) for c, f in zip(copies, faults, strict=True) if f != BLANK))
            counts += [sum(f == TRUNCATED for f in faults), pairs + sum(copies) - len(copies), int(cost[i])]
            out.append((conv, seg, "".join(audit), len(lines), "\n".join(lines), counts, initials[0], initials[-1]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()]
        names = ["conv_id", "seg", "audit", "lines", "body", "counts", "first", "final"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)


def _together(batches):
    """Rows of _repaired in order to one row a conversation; one segment is held at a time."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    begun, conv, done = False, None, []

    def result():
        return (conv, *sums.tolist(), "".join(audits), digest.hexdigest())

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], names=names)

    for batch in batches:
        for key, _, audit, n, body, counts, first, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or key != conv:
                if begun:
                    done.append(result())
                begun, conv, sums, audits, digest, lines, before = True, key, np.zeros(5, np.int64), [], hashlib.sha256(), 0, None
            sums += counts
            sums[3] += before is not None and before + first not in ("su", "ua", "au")
            before = final
            audits.append(audit)
            if n:
                digest.update((b"\n" if lines else b"") + body.encode())
                lines += n
        if done:
            yield rows(done)
            done = []
    if begun:
        yield rows([result()])


def _doubled(table: DataFrame, column: str, joined, ahead: bool) -> DataFrame:
    """Combine ``column`` of each segment with that of the segments after (or before) it in its conversation."""
    reach = (table.agg(F.max(F.col("until") - F.col("since"))).first()[0] or 0) + 1
    span = 1
    while span < reach:
        other = table.select((F.col("seg") + (-span if ahead else span)).alias("seg"), F.col(column).alias("other"))
        within = F.col("seg") + span <= F.col("until") if ahead else F.col("seg") - span >= F.col("since")
        table = table.join(dealt(other), "seg", "left").withColumn(column, F.when(within, joined(F.col(column), F.col("other"))).otherwise(F.col(column)))
        table = materialize(table.select("seg", "since", "until", column), "doubled")
        span *= 2
    return table


def _product(x, y):
    """Least costs over both of two 4 x 4 matrices, row by row in one array."""
    def cell(i):
        return F.least(F.lit(NEVER), *[F.get(x, F.floor(i / 4).cast("int") * 4 + k) + F.get(y, i % 4 + 4 * k) for k in range(4)])

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def segmented(rows: DataFrame) -> DataFrame:
    """Segments of the sorted rows, with ``seg``, their number throughout."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(placed.select("conv_id", "role", "text", "copies", "fault").mapInArrow(_cut, SEGMENT), "segments")
    counts = sorted((r.task, r.n) for r in cut.groupBy("task").agg(F.count("*").alias("n")).collect())  # one number for each task
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = cut.sparkSession.createDataFrame([(t, s) for (t, _), s in zip(counts, starts, strict=False)], "task int, start long")
    return cut.join(offsets, "task").withColumn("seg", F.col("start") + F.col("number")).drop("task", "number", "start")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first, by crc32 of ``conv_id:turn``. Null roles and texts
    are one space; rows without a turn come first; rows of one turn go by role
    and text; rows without a conv_id are one conversation, whose id is null.
    Repeated rows are duplicates. A conversation of which no row is left has
    zeros, no edits and the hash of the empty string. An empty table gives no
    rows. Other columns are not read.
    """
    small_batches(conversations.sparkSession)
    all_rows = materialize(damaged(conversations), "damaged")
    rows = all_rows.where("copies > 0")
    segments = materialize(segmented(faulty(rows)), "numbered")

    bounds = segments.groupBy("conv_id").agg(F.min("seg").alias("since"), F.max("seg").alias("until"), F.count("*").alias("n")).where("n > 1").select("since", "until")
    # a conversation's segments follow each other: those between its first and last number are its own
    long = segments.select("conv_id", "seg", "initials", "faults", "copies")
    spans = materialize(bounds.select("since", "until", F.explode(F.sequence("since", "until")).alias("seg")), "spans")
    long = materialize(long.join(dealt(spans), "seg"), "long")
    costs = long.select("seg", "initials", "faults", "copies").mapInArrow(_matrices, "seg long, costs array<long>")
    costs = _doubled(materialize(costs.join(dealt(spans), "seg"), "costs"), "costs", _product, ahead=True)
    # what is still to come after a segment is what the next one's states cost
    state = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.least(*[F.get("costs", i.cast("int") * 4 + k) + int(END[k]) for k in range(4)])
    )
    ahead = costs.where("seg > since").select((F.col("seg") - 1).alias("seg"), state.alias("ahead"))
    ahead = materialize(ahead, "ahead")
    exits = long.join(dealt(ahead), "seg", "left").select("seg", "initials", "faults", "copies", "ahead").mapInArrow(_exits, "seg long, exits array<int>")
    exits = _doubled(materialize(exits.join(dealt(spans), "seg"), "exits"), "exits", lambda own, other: F.transform(other, lambda x: F.get(own, x)), ahead=False)
    entry = exits.where("seg < until").select((F.col("seg") + 1).alias("seg"), F.get("exits", F.lit(0)).alias("entry"))
    entry = materialize(entry, "entries")

    joined = segments.join(ahead, "seg", "left").join(entry, "seg", "left").withColumn("entry", F.coalesce("entry", F.lit(S)))
    done = joined.mapInArrow(
        _repaired, "conv_id long, seg long, audit string, lines long, body string, counts array<long>, first string, final string"
    )
    kinds = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    done = done.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_together, kinds)
    done = materialize(done, "repaired").withColumnRenamed("conv_id", "key")

    width = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(width, F.lit(0)).cast("long").alias("gaps")).select(F.col("conv_id").alias("of"), "gaps")
    every = all_rows.select("conv_id").distinct()
    every = every.join(dealt(gaps), F.col("conv_id").eqNullSafe(F.col("of")), "left").join(dealt(done), F.col("conv_id").eqNullSafe(F.col("key")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    out = materialize(out, "conversations")
    for table in (all_rows, segments, long):
        discard(table)
    return out
