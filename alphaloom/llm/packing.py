"""Packing token sequences by non-negative least squares over a length histogram.

A document is cut into whole windows and one remainder.  The histogram of
remainder lengths (one entry for each length below the window) comes to
the driver, where shallow combinations of two or three lengths that fill a
window are enumerated and their repeat counts solved by non-negative least
squares against the histogram, rounded down, and topped up greedily.  A
remainder's rank among those of its length then says which combination, copy
and place it takes, so the assignment needs no search and no shuffle of
ids.  What the combinations leave over is laid end to end and cut at the window;
the tail is cut into powers of two, which need no padding.

Ranks and stream positions are two-level prefix sums (per part, then within),
so a length that a third of all documents share is spread over all parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of
from .tokens import binary_rows, encoder, id_type, with_end

WINDOW = 2048
END_ID = 1
TOP_LENGTHS = 64            # lengths from which combinations of three are built
NNLS_STEPS = 1500
ROWS_AT_ONCE = 500          # documents whose pieces are cut at once


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window, all of them present:
    every pair, and every triple with two of the most frequent lengths."""
    present = histogram > 0
    low = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(low), low, window - low], axis=1)
    top = np.argsort(-histogram, kind="stable")[:TOP_LENGTHS]
    top = top[histogram[top] > 0]
    a, b = (x.ravel() for x in np.meshgrid(top, top))
    c = window - a - b
    triples = np.sort(np.stack([a, b, c], axis=1)[c > 0], axis=1)
    rows = np.unique(np.concatenate([pairs, triples.reshape(-1, 3)]), axis=0)
    return rows[(present[rows] | (rows == 0)).all(axis=1)]


def use_counts(rows: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    return np.bincount(rows.ravel(), np.repeat(x, 3), minlength=window)[:window] * (np.arange(window) > 0)


def solve_repeats(histogram: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Whole repeat counts that never use a length more often than it occurs."""
    h = histogram.astype(float)
    if not len(rows):
        return np.zeros(0, np.int64)
    row_use = np.bincount(rows.ravel(), minlength=window)[1:].max()
    step = 1.0 / (9.0 * row_use)            # 1 / bound of the Gram matrix's largest eigenvalue
    x = np.zeros(len(rows))
    y, t = x, 1.0
    held = (rows > 0)
    for _ in range(NNLS_STEPS):             # accelerated projected gradient
        miss = use_counts(rows, y, window) - h
        nxt = np.maximum(0, y - step * (miss[rows] * held).sum(axis=1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    copies = np.zeros(len(rows), np.int64)
    left = histogram.astype(np.int64).copy()
    order = np.argsort(-x, kind="stable")
    for limit in (np.floor(x), np.full(len(rows), np.inf)):     # rounded solution, then greedily
        for p in order:
            lengths, times = np.unique(rows[p][rows[p] > 0], return_counts=True)
            n = int(min(limit[p], (left[lengths] // times).min()))
            if n > 0:
                copies[p] += n
                left[lengths] -= n * times
    return copies


class Assignment:
    """Sequence and offset of the r-th remainder of a length, from the repeat counts."""

    def __init__(self, rows: np.ndarray, copies: np.ndarray, first_sequence: int, window: int):
        used = np.flatnonzero(copies)
        base = first_sequence + np.r_[0, np.cumsum(copies[used])]
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, p in enumerate(used):
            offset = 0
            for length in rows[p][rows[p] > 0]:
                entries.setdefault(int(length), []).append((int(copies[p]), int(base[k]), offset))
                offset += int(length)
        self.sequences = int(copies.sum())
        self.by_length = {length: (np.cumsum([e[0] for e in es]), np.array(es, np.int64))
                          for length, es in entries.items()}

    def taken(self, length: int) -> int:
        return int(self.by_length[length][0][-1]) if length in self.by_length else 0

    def place(self, length: int, rank: int) -> tuple[int, int]:
        ends, entries = self.by_length[length]
        k = int(np.searchsorted(ends, rank, side="right"))
        copies, base, offset = entries[k]
        return int(base + rank - (ends[k] - copies)), int(offset)


def stream_pieces(at: int, length: int, total: int, first_sequence: int, window: int) -> list[tuple[int, int, int]]:
    """(length, sequence, offset) of a run at ``at`` of the left-over stream of
    ``total`` tokens: whole windows, then one sequence per binary digit."""
    whole = total // window
    out = []
    while length:
        k, offset = divmod(at, window)
        room, sequence = window - offset, first_sequence + k
        if k == whole:                      # in the tail
            size, start, sequence = window // 2, whole * window, first_sequence + whole
            rest = total - start
            while True:
                while not rest & size:
                    size //= 2
                if at < start + size:
                    break
                start, rest, sequence = start + size, rest - size, sequence + 1
            room, offset = start + size - at, at - start
        n = min(length, room)
        out.append((n, sequence, offset))
        at, length = at + n, length - n
    return out


def token_table(docs: DataFrame, vocabulary: str, end_id: int, kind: str) -> DataFrame:
    """(part, row, doc_id, n, ids): each document's ids (two or four bytes each)
    with ``end_id``, numbered within the task that read it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        coder = encoder(vocabulary)
        for batch in batches:
            for at, ids, counts in coder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                m = len(counts)
                yield pa.record_batch([
                    pa.array(np.full(m, part, np.int32)), pa.array(np.arange(row, row + m)),
                    batch.column(0).slice(at, m), pa.array(counts), binary_rows(ids.astype(kind), counts)],
                    names=["part", "row", "doc_id", "n", "ids"])
                row += m
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "part int, row bigint, doc_id bigint, n bigint, ids binary")


def before(sums: DataFrame, value: str, *keys: str) -> DataFrame:
    """Sum of ``value`` over earlier parts (within ``keys``)."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(value, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def part_offsets(rows: DataFrame, value: str) -> dict[int, int]:
    """Running total of ``value`` before each part: one number per input split."""
    out, run = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum(value).alias("v")).collect()):
        out[part] = run
        run += n
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids (little-endian, four bytes each) if wanted.

    Every id lies in one piece; a sequence's pieces fill it without gaps; every
    sequence is a whole window or a power of two, so nothing is padded.  Null
    and empty texts are the end id alone.  Rows that repeat an id are documents
    each.  Other columns are ignored; an empty table gives no rows."""
    kind = id_type(vocabulary)
    tokens = materialize(token_table(docs, vocabulary, end_id, kind), "pack-tokens", compression="zstd")
    rest = F.col("n") % F.lit(window)
    sizes = tokens.select("part", "row", "n", F.floor(F.col("n") / F.lit(window)).alias("whole"), rest.alias("rest"))
    by_part = materialize(sizes.where("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c")), "pack-hist")
    histogram = np.zeros(window, np.int64)
    for length, c in by_part.groupBy("rest").agg(F.sum("c").alias("c")).collect():
        histogram[length] = c
    rows = combinations(histogram, window)
    copies = solve_repeats(histogram, rows, window)
    whole_before = part_offsets(sizes, "whole")
    windows = sizes.agg(F.sum("whole")).first()[0] or 0
    assigned = Assignment(rows, copies, windows, window)
    stream_first = windows + assigned.sequences
    left = [histogram[n] - assigned.taken(n) for n in range(window)]
    total = int(sum(n * c for n, c in enumerate(left)))

    spark = docs.sparkSession
    taken = spark.createDataFrame([(n, assigned.taken(n)) for n in range(1, window)], "rest bigint, taken bigint")
    bases = before(by_part, "c", "rest").select("part", "rest", F.col("c").alias("base"))
    local = Window.partitionBy("part", "rest").orderBy("row")
    ranked = sizes.where("rest > 0").withColumn("own", F.row_number().over(local) - 1)
    ranked = ranked.join(bases, ["part", "rest"]).join(F.broadcast(taken), "rest")      # one row for each length below the window
    ranked = ranked.select("part", "row", "rest", (F.col("base") + F.col("own")).alias("rank"), "taken")
    ranked = ranked.withColumn("spill", F.when(F.col("rank") >= F.col("taken"), F.col("rest")).otherwise(0))
    ranked = materialize(ranked, "pack-ranks")
    spill_before = part_offsets(ranked, "spill")

    # Positions within a part run over its rows in order.
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.join(ranked.select("part", "row", "rank", "spill"), ["part", "row"], "left")
    plan = plan.select("part", "row", "rest", "rank", F.coalesce("spill", F.lit(0)).alias("spill"),
                       F.coalesce(F.sum("whole").over(inside), F.lit(0)).alias("windows"),
                       F.coalesce(F.sum("spill").over(inside), F.lit(0)).alias("at"))
    joined = tokens.join(plan, ["part", "row"]).select("part", "doc_id", "n", "ids", "rest", "rank", "spill", "windows", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            out = []
            blobs = batch.column(3)
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6, 7, 8)]
            for i, (part, doc_id, n, rest, rank, spill, windows_in, at) in enumerate(zip(*columns)):
                ids = memoryview(np.frombuffer(blobs[i].as_buffer(), kind).astype("<u4").tobytes())
                first = whole_before[part] + windows_in
                pieces = [(window, first + k, 0) for k in range(n // window)]
                if spill:
                    pieces += stream_pieces(spill_before[part] + at, rest, total, stream_first, window)
                elif rest:
                    pieces.append((rest, *assigned.place(rest, rank)))
                start = 0
                for length, sequence, offset in pieces:
                    raw = ids[4 * start:4 * (start + length)]
                    out.append((doc_id, start, length, zlib.crc32(raw), n, sequence, offset, bytes(raw) if with_ids else None))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [pa.int64()] * 7 + [pa.binary()]
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    found = joined.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                                   "sequence_id bigint, offset bigint, ids binary")
    return found if with_ids else found.drop("ids")
