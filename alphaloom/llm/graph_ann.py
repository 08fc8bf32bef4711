"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Distinct vectors are dealt to shards by their number of components, a band of their length and a
hash, so the lengths within a shard differ by ``BAND`` at most.  Each shard becomes a
directed graph: points are inserted in growing batches, a greedy beam search of
the graph so far proposes neighbours, and relaxed distance pruning keeps a
neighbour only if no nearer one already kept is closer to it by the factor
``RELAX``, so the edges point in different directions.  Vectors get one more
coordinate that gives all the same length, which turns the largest inner product into
the smallest distance; beside a far longer vector the others' differences would vanish
in rounding, hence the bands.  Graphs work in single precision on vectors scaled by a power of
two, so no finite length overflows.  Queries search every shard of their number of components by beam
search, some hundred in lock-step; scores are then computed in double precision on the original vectors.

Shards are as large as a task's memory allows (``SHARD_ROWS``, ``SHARD_BYTES``), because each query visits each.
Queries travel as blocks of one row; a shard's graph is read once by a task through which
the blocks stream, and is repeated only as often as tasks would otherwise be idle.

Rows with the same vector are one node.  A node carries its smallest vec_ids, one
more than the neighbours asked for, which is all that ties to smaller ids can
need; so thousands of copies neither fill the graph nor hide each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

SHARD_ROWS = 32768          # distinct vectors of a shard (expected), fewer where they are long:
SHARD_BYTES = 64 << 20      # of components in single precision
QUERY_BLOCK = 512           # queries in a row (expected)
DEGREE, SLACK = 24, 16      # edges kept when a node is pruned, and room beyond them until it is
BUILD_BEAM, SEARCH_BEAM = 64, 160
EXPAND = 4                  # nodes expanded in one step of a search
RELAX = 1.2
BAND = 16                   # largest ratio of two lengths in a shard
LOCKSTEP = 256

INDEX_SCHEMA = "shard bigint, node int, entry boolean, ids array<bigint>, vec array<double>, edges array<int>"
FOUND_SCHEMA = "qrow bigint, query_id bigint, vec_id bigint, score double"


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, vec) of the rows that take part: an id, and a vector of finite
    components that are not all zero, of any number.  ``row`` tells rows apart that repeat an id."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL").where(finite & F.exists("vec", lambda v: v != 0))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(vec, ids): each vector with its ``ids`` smallest vec_ids, an id once for each of its rows."""
    per = rows.groupBy("vec", "vec_id").agg(F.count(F.lit(1)).alias("n"))           # copies are added up before they meet
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = per.withColumn("at", F.row_number().over(first)).where(F.col("at") <= ids)
    few = few.withColumn("own", F.array_repeat("vec_id", F.least(F.col("n"), F.lit(ids)).cast("int")))
    return few.groupBy("vec").agg(F.slice(F.sort_array(F.flatten(F.collect_list("own"))), 1, ids).alias("ids"))


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers (queries x beam, best inner product first, -1 where none) that
    a greedy search of the graph from ``entry`` meets."""
    n, b = len(points), len(queries)
    ids = np.full((b, beam), -1, np.int64)
    ids[:, 0] = entry
    score = np.full((b, beam), -np.inf, np.float32)
    score[:, 0] = queries @ points[entry]
    done = np.ones((b, beam), bool)
    done[:, 0] = False
    seen = np.zeros((b, n + 1), bool)       # the last column stands for "no node"
    seen[:, entry] = seen[:, n] = True
    active = np.arange(b)
    while len(active):
        own = ids[active]
        fresh = ~done[active]
        turn = np.cumsum(fresh, axis=1)
        pick = np.argsort(~(fresh & (turn <= EXPAND)), axis=1, kind="stable")[:, :EXPAND]
        usable = np.take_along_axis(fresh, pick, axis=1)
        nodes = np.where(usable, np.take_along_axis(own, pick, axis=1), -1)
        done[active[:, None], pick] = True
        near = np.where((nodes >= 0)[:, :, None], graph[nodes], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        seen[active[:, None], near] = True
        reach = np.matmul(points[np.minimum(near, n - 1)], queries[active][:, :, None])[:, :, 0]
        reach[near == n] = -np.inf
        all_ids = np.concatenate([own, np.where(near == n, -1, near)], axis=1)
        all_score = np.concatenate([score[active], reach], axis=1)
        all_done = np.concatenate([done[active], near == n], axis=1)
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        score[active] = np.take_along_axis(all_score, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
        active = active[~done[active].all(axis=1)]
    return ids


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (-1: none): the nearest one left
    is kept, and drops all that are nearer to it than to ``own`` by ``relax``."""
    b = len(own)
    x = points[np.maximum(candidates, 0)]
    square = float((points[0] ** 2).sum())              # all points have this squared length
    to_own = 2 * (square - np.matmul(x, points[own][:, :, None])[:, :, 0])
    between = 2 * (square - x @ x.transpose(0, 2, 1))
    order = np.argsort(candidates, axis=1, kind="stable")
    ranked = np.take_along_axis(candidates, order, axis=1)
    repeat = np.zeros(candidates.shape, bool)
    np.put_along_axis(repeat, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
    alive = (candidates >= 0) & (candidates != own[:, None]) & ~repeat
    kept = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        if not alive.any():
            break
        nearest = np.argmin(np.where(alive, to_own, np.inf), axis=1)
        some = alive[rows, nearest]
        kept[some, k] = candidates[rows, nearest][some]
        alive[rows, nearest] = False
        drop = relax * relax * between[rows, nearest] <= to_own
        alive &= ~(drop & some[:, None])
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX,
                seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (nodes x (degree + SLACK), -1 where none) and the entry node."""
    n, room = len(vectors), degree + SLACK
    points = lifted(vectors)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    graph = np.full((n, room), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]]
    at, size = 1, 1
    while at < n:
        batch = order[at:at + min(size, LOCKSTEP)]
        found = beam_search(points, graph, entry, points[batch], beam)
        graph[batch, :degree] = robust_prune(points, batch, found, degree, relax)
        source, target = np.repeat(batch, degree), graph[batch, :degree].ravel()    # the reverse edges
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        used = (graph[nodes] >= 0).sum(axis=1)
        fits = used + count <= room
        slot = np.arange(len(target)) - np.repeat(first, count) + np.repeat(used, count)
        ok = np.repeat(fits, count)
        graph[target[ok], slot[ok]] = source[ok]
        full = nodes[~fits]
        for i in range(0, len(full), LOCKSTEP):
            part = full[i:i + LOCKSTEP]
            width = int(count[~fits][i:i + LOCKSTEP].max())
            extra = np.full((len(part), width), -1, np.int64)
            for r, (f, c) in enumerate(zip(first[~fits][i:i + LOCKSTEP], count[~fits][i:i + LOCKSTEP])):
                extra[r, :c] = source[f:f + c]
            pruned = robust_prune(points, part, np.concatenate([graph[part], extra], axis=1), degree, relax)
            graph[part, :degree], graph[part, degree:] = pruned, -1
        at += len(batch)
        size *= 2
    return graph, entry


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings the largest component to 0.5-1."""
    largest = np.abs(vectors).max(initial=0)
    return np.ldexp(vectors.astype(np.float64), -int(np.frexp(np.float64(largest))[1]))


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Scaled vectors with one more coordinate that gives all the largest length."""
    points = scaled(vectors)
    square = (points ** 2).sum(axis=1)
    return np.column_stack([points, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def banded(nodes: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """``nodes`` with their shard, and the shards of each number of components.  Each band of lengths has
    shards of its own; a length of 1 lies in the middle of one.  One row per band comes to the driver."""
    def log_length(largest):
        square = F.aggregate("vec", F.lit(0.0), lambda total, v: total + (v / largest) * (v / largest))
        return F.log2(largest) + F.log2(square) / 2
    largest = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    length = F.get(F.transform(F.array(largest), log_length), F.lit(0))      # the largest is found once for a row
    width = float(np.log2(BAND))
    nodes = nodes.withColumns({"d": F.size("vec"), "band": F.floor(length / F.lit(width) + F.lit(0.5))})
    nodes = materialize(nodes, "ann-bands")
    found = nodes.groupBy("d", "band").agg(F.count(F.lit(1)).alias("n")).orderBy("d", "band").collect()
    plan, first, by = [], 0, {}
    for r in found:
        shards = -(-r["n"] // max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * r["d"]))))
        plan.append((r["d"], r["band"], first, shards))
        by.setdefault(r["d"], []).extend(range(first, first + shards))
        first += shards
    plan = nodes.sparkSession.createDataFrame(plan, "d int, band bigint, first bigint, shards bigint")
    own = F.col("first") + F.pmod(F.xxhash64(F.element_at("ids", 1), F.col("vec")), F.col("shards"))
    return nodes.join(F.broadcast(plan), ["d", "band"]).select("vec", "ids", own.alias("shard")), by


def build_index(nodes: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """Graph rows (INDEX_SCHEMA) of distinct vectors, and the shards of each number of components."""
    dealt, by = banded(nodes)

    def build(group: pa.Table) -> pa.Table:
        graph, entry = build_graph(as_matrix(group.column("vec")))
        n = len(graph)
        edges = pa.array([row[row >= 0] for row in graph], pa.list_(pa.int32()))
        return pa.table({"shard": group.column("shard"), "node": pa.array(np.arange(n, dtype=np.int32)),
                         "entry": pa.array(np.arange(n) == entry), "ids": group.column("ids"),
                         "vec": group.column("vec"), "edges": edges})
    return materialize(dealt.groupBy("shard").applyInArrow(build, INDEX_SCHEMA), "ann-index"), by


class Shard:
    """One graph, read from its rows, and how queries search it."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy())))
        self.vectors = as_matrix(rows.column("vec"))
        self.near = scaled(self.vectors).astype(np.float32)
        lists = rows.column("edges").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        self.graph = np.full((len(self.vectors), max(int(sizes.max()), 1)), -1, np.int64)
        self.graph[np.arange(self.graph.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        self.entry = int(np.flatnonzero(rows.column("entry").to_numpy())[0])
        self.members = rows.column("ids").combine_chunks()

    def nearest(self, q_rows: list[int], q_ids: list[int], q: np.ndarray, k: int) -> Iterator[tuple]:
        """(qrow, query_id, vec_id, score) of the best ``k`` for each query.  A query
        leaves out one row of its id at its own vector: itself."""
        spare = k + 1
        for at in range(0, len(q), LOCKSTEP):
            part = q[at:at + LOCKSTEP]
            asked_for = np.concatenate([scaled(v) for v in part[:, None]]).astype(np.float32)
            found = beam_search(self.near, self.graph, self.entry, asked_for, SEARCH_BEAM)
            for row, own, query, hits in zip(q_rows[at:at + LOCKSTEP], q_ids[at:at + LOCKSTEP], part, found):
                hits = hits[hits >= 0]
                scores = np.array([query @ self.vectors[h] for h in hits])
                pairs = []
                for h in np.argsort(-scores, kind="stable")[:spare + 8]:
                    ids = self.members[int(hits[h])].as_py()
                    if own in ids and (self.vectors[hits[h]] == query).all():
                        ids.remove(own)
                    pairs += [(-scores[h], v) for v in ids]
                for s, v in sorted(pairs)[:k]:
                    yield row, own, v, -s


def search(index: DataFrame, shards: dict[int, list[int]], queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for query rows (row, vec_id, vec)."""
    spark = index.sparkSession
    total = sum(map(len, shards.values()))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    copies = min(-(-shuffle_partitions(spark) // total), blocks)    # of a graph, so that no task is idle
    packed = queries.withColumns({"d": F.size("vec"), "block": F.pmod(F.xxhash64("row"), F.lit(blocks))}) \
        .groupBy("d", "block").agg(F.collect_list(F.struct("row", "vec_id", "vec")).alias("asked"))
    plan = spark.createDataFrame(list(shards.items()), "d int, own array<bigint>")
    asked = packed.join(F.broadcast(plan), "d").select(
        F.explode("own").alias("shard"), F.pmod(F.col("block"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"),
        *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in INDEX_SCHEMA.split(", ")[1:])], "asked")
    graphs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"),
                          "node", "entry", "ids", "vec", "edges", F.lit(None).cast(packed.schema["asked"].dataType).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                piece, here, kind = batch.slice(start, stop - start), tuple(place[:2, start]), place[2, start]
                if here != now:
                    now, parts, shard = here, [], None
                if kind == 0:
                    parts.append(piece)
                    continue
                if shard is None:
                    shard, parts = Shard(pa.Table.from_batches(parts)), []
                for asked in piece.column(8):
                    own = asked.values
                    vectors = own.field("vec")
                    q = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
                    got = list(shard.nearest(own.field("row").to_pylist(), own.field("vec_id").to_pylist(), q, k))
                    cols = list(zip(*got)) or [(), (), (), ()]
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.float64())], names=["qrow", "query_id", "vec_id", "score"])
    dealt = graphs.unionByName(asked).repartitionById(total * copies, (F.col("shard") * copies + F.col("copy")).cast("int"))
    found = dealt.sortWithinPartitions("shard", "copy", "kind").mapInArrow(run, FOUND_SCHEMA)
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each query (rows whose vec_id is divisible by
    ``every``) among all other rows, ties to the smaller vec_id.

    Rows without an id, and vectors that are null, empty, zero, or hold null or non-finite
    components, take no part.  Vectors of different numbers of components have no inner product: each number
    is searched by itself.  Rows that repeat an id are rows each, as queries and as
    candidates.  Other columns are ignored; with fewer than ``k`` candidates all are returned; an empty table
    gives no rows."""
    rows = clean_vectors(vectors)
    index, shards = build_index(distinct_vectors(rows, k + 1))
    return search(index, shards, rows.where(F.col("vec_id") % F.lit(every) == 0), k)
