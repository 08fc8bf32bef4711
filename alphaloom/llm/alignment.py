"""Cross-tokenizer alignment, with corpus-wide counts of the linked id pairs.

Tokens of two tokenizers over one text are linked where their bytes overlap; a pair's
count is the number of documents that hold it linked.  The count is external:

1. Documents are aligned some megabytes at a time.  The pair-document records
   of such a run are sorted in side-major order (all pairs of one A id together) and
   radix-partitioned by A id into zstd blocks, which are written as a table.
2. The tasks of a radix partition merge the sorted pairs of its runs through a heap
   (at most FAN_IN runs at once, in levels where there are more) and add up
   their documents.  As the merge runs in side-major order, an A id's pairs
   leave it together, and with them the highest of their counts.
3. The merged counts are streamed past the runs of their radix partition again, and what each
   run's pairs count for goes back to the run, where they are added up per document.

What is shuffled are a run's pairs (once there, once back) and its records
once, all as zstd blocks; no pair is ever a key of its own, and a pair that
every document holds appears once in each run.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_of
from .two_tokens import PairEncoder, pair_encoder

RUN_BYTES = 8 << 20             # text of a run (a longer document is a run of its own)
RUN_DOCS = 1 << 20
FAN_IN = 256                    # runs that one merge opens, and that one task of step 3 streams
RADIX_PARTITIONS = 512          # at most
MERGE_BLOCK = 4096              # pairs of a run that enter a merge at once
EMIT = 1 << 17                  # pairs that a merge gathers before it adds them up
SPREAD = 40503                  # fixed value: odd, so that A ids change places one to one

RUN_SCHEMA = ("run bigint, radix int, first bigint, pairs binary, docs binary, members binary, "
              "doc_ids array<bigint>, tokens array<bigint>, groups array<binary>")
LEVEL_SCHEMA = "run bigint, radix int, first bigint, pairs binary, docs binary"
TOTAL_SCHEMA = "radix int, first bigint, pairs binary, docs binary, best binary"


def packed(values: np.ndarray) -> bytes:
    """zstd over byte planes (all lowest bytes, then all next ones, ...)."""
    import zstandard
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Ascending pairs as differences."""
    return packed(np.diff(pairs.astype(np.uint32), prepend=np.uint32(0)))


def unpacked_pairs(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u4"), dtype=np.uint32)


class Sides:
    """How a pair of ids is written as one number: the A id, moved one to one so that
    frequent ids don't lie side by side, above the B id."""

    def __init__(self, coder: PairEncoder):
        self.b_bits = coder.b_bits
        self.a_bits = max(1, int(len(coder.a_bytes) - 1).bit_length())
        self.back = pow(SPREAD, -1, 1 << self.a_bits)

    def keys(self, links: np.ndarray) -> np.ndarray:
        links = links.astype(np.int64)
        a = (links >> self.b_bits) * SPREAD & ((1 << self.a_bits) - 1)
        return a << self.b_bits | links & ((1 << self.b_bits) - 1)

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.int64)
        return (keys >> self.b_bits) * self.back & ((1 << self.a_bits) - 1), keys & ((1 << self.b_bits) - 1)

    def radix_ends(self, partitions: int) -> np.ndarray:
        """First key of every radix partition but the first."""
        return -(-(np.arange(1, partitions, dtype=np.int64) << self.a_bits) // partitions) << self.b_bits


def run_sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def document_runs(docs: DataFrame, a_path: str, b_path: str, partitions: int, run_bytes: int, with_groups: bool) -> DataFrame:
    """The written runs: a row for each radix partition of a run, and one (radix -1) with its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pair_encoder(a_path, b_path)
        sides = Sides(coder)
        ends, number = sides.radix_ends(partitions), TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, at = np.cumsum(size), 0
            while at < batch.num_rows:
                limit = (upto[at - 1] if at else 0) + run_bytes
                stop = min(max(at + 1, int(np.searchsorted(upto, limit, side="right"))), at + RUN_DOCS)
                yield _one_run(batch.slice(at, stop - at), coder, sides, ends, number, with_groups)
                at, number = stop, number + 1
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return materialize(rows.mapInArrow(run, RUN_SCHEMA), "alignment-runs")


def _one_run(batch: pa.RecordBatch, coder: PairEncoder, sides: Sides, ends: np.ndarray, number: int,
             with_groups: bool) -> pa.RecordBatch:
    texts, n = batch.column(1), batch.num_rows
    own = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    coded, offsets = coder.chunks(texts.take(pa.array(own)))
    index = coded.indices.to_numpy(zero_copy_only=False)
    found = coder.lookup(coded.dictionary)
    per = np.add.reduceat(found.counts[index], offsets[:-1]) if len(own) else np.zeros((0, 3), np.int32)
    bad = np.logical_or.reduceat(found.counts[index, 0] < 0, offsets[:-1]) if len(own) else np.zeros(0, bool)
    size = np.diff(found.starts)
    in_chunk = np.where(np.repeat(bad, np.diff(offsets)), 0, size[index])
    spread = np.repeat(found.starts[:-1][index] - np.cumsum(in_chunk) + in_chunk, in_chunk)
    links = sides.keys(found.links)[spread + np.arange(len(spread))]
    doc = np.repeat(np.repeat(own, np.diff(offsets)), in_chunk)
    records, times = run_sums(np.sort(links * RUN_DOCS + doc))
    pairs, docs = run_sums(records // RUN_DOCS)
    members = (records % RUN_DOCS).astype(np.uint32)
    pair_at = np.r_[0, np.searchsorted(pairs, ends), len(pairs)]
    record_at = np.r_[0, np.cumsum(docs)][pair_at]

    tokens = np.zeros((n, 4), np.int64)
    tokens[own, :3] = np.where(bad[:, None], 0, per)
    tokens[:, 3] = np.bincount(doc, minlength=n)
    groups = [b""] * n
    index_list, cuts = index.tolist(), offsets.tolist()
    for k, i in enumerate(own.tolist()):
        if not bad[k]:
            text = b";".join([found.groups[c] for c in index_list[cuts[k]:cuts[k + 1]]])
            groups[i] = text if with_groups else hashlib.sha256(text).digest()
    rows = {c: [] for c in ("radix", "first", "pairs", "docs", "members")}
    for r in np.flatnonzero(np.diff(pair_at)).tolist():
        part, held = slice(pair_at[r], pair_at[r + 1]), slice(record_at[r], record_at[r + 1])
        rows["radix"].append(r)
        rows["first"].append(int(pairs[pair_at[r]]))
        rows["pairs"].append(packed_pairs(pairs[part]))
        rows["docs"].append(packed(docs[part].astype("<u4")))
        rows["members"].append(packed(np.r_[members[held], times[held].astype(np.uint32)].astype("<u4")))
    m = len(rows["radix"])
    return pa.record_batch([
        pa.array([number] * (m + 1), pa.int64()), pa.array([-1, *rows["radix"]], pa.int32()),
        pa.array([None, *rows["first"]], pa.int64()), pa.array([None, *rows["pairs"]], pa.binary()),
        pa.array([None, *rows["docs"]], pa.binary()), pa.array([None, *rows["members"]], pa.binary()),
        pa.array([batch.column(0).to_pylist()] + [None] * m, pa.list_(pa.int64())),
        pa.array([tokens.ravel()] + [None] * m, pa.list_(pa.int64())), pa.array([groups] + [None] * m, pa.list_(pa.binary()))],
        names=["run", "radix", "first", "pairs", "docs", "members", "doc_ids", "tokens", "groups"])


def heap_merge(runs: list[tuple[int, Callable]], group_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge runs, each given by its first pair and a function that opens it
    (ascending pairs, their counts), into ascending (pairs, summed counts).

    The heap holds the first pair of what each run still has; a run's next block
    enters when its turn comes.  Nothing that a run still holds is below the heap's least
    pair, so what has gathered below it is final; pieces end where a group ends
    (pairs that agree above ``group_bits``), so no group is cut."""
    heap = [(first, i, 0) for i, (first, _) in enumerate(runs)]
    heapq.heapify(heap)
    opened, pairs, counts, held, wait = {}, [], [], 0, EMIT
    while heap:
        _, i, at = heapq.heappop(heap)
        if at == 0:
            opened[i] = runs[i][1]()
        own_pairs, own_counts = opened[i]
        stop = at + MERGE_BLOCK
        pairs.append(own_pairs[at:stop])
        counts.append(own_counts[at:stop].astype(np.int64))
        held += len(pairs[-1])
        if stop < len(own_pairs):
            heapq.heappush(heap, (int(own_pairs[stop]), i, stop))
        else:
            del opened[i]
        if held >= wait or not heap:
            flat, n = np.concatenate(pairs), np.concatenate(counts)
            order = np.argsort(flat, kind="stable")
            flat, n = flat[order], n[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            flat, n = flat[first], np.add.reduceat(n, first)
            cut = int(np.searchsorted(flat, heap[0][0] >> group_bits << group_bits)) if heap else len(flat)
            if cut:
                yield flat[:cut], n[:cut]
            pairs, counts, held = [flat[cut:]], [n[cut:]], len(flat) - cut
            wait = EMIT + 2 * held


def _keyed(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict]]:
    """Rows of batches as (first ``keys`` columns, the others by name)."""
    for batch in batches:
        names = batch.schema.names
        lists = [c.to_pylist() if not pa.types.is_binary(c.type) else c for c in batch.columns]
        for k in range(batch.num_rows):
            row = [c[k] if isinstance(c, list) else c[k].as_py() for c in lists]
            yield tuple(row[:keys]), dict(zip(names[keys:], row[keys:]))


def _opener(row: dict, kind: str) -> tuple[int, Callable]:
    return row["first"], lambda: (unpacked_pairs(row["pairs"]), unpacked(row["docs"], kind))


def merged_level(runs: DataFrame, partitions: int, groups: int, kind: str, b_bits: int, last: bool) -> DataFrame:
    """One row or more for each (radix, group of runs), merged; at the last level, with
    a mark for pairs whose count is their A id's highest."""
    dealt = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("grp"), "first", "pairs", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: tuple, held: list) -> Iterator[pa.RecordBatch]:
            for pairs, n in heap_merge(held, b_bits):
                common = {"radix": pa.array([key[0]], pa.int32()), "first": pa.array([int(pairs[0])], pa.int64()),
                          "pairs": pa.array([packed_pairs(pairs)], pa.binary()),
                          "docs": pa.array([packed(n.astype("<i8"))], pa.binary())}
                if last:
                    side = pairs >> b_bits
                    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
                    best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(n)]))
                    common["best"] = pa.array([packed(np.packbits(best))], pa.binary())
                    yield pa.RecordBatch.from_pydict(common)
                else:
                    yield pa.RecordBatch.from_pydict({"run": pa.array([key[1]], pa.int64())} | common)
        now, held = None, []
        for key, row in _keyed(batches, 2):
            if key != now and held:
                yield from flush(now, held)
                held = []
            now = key
            held.append(_opener(row, kind))
        if held:
            yield from flush(now, held)
    spread = dealt.repartitionById(partitions * groups, F.col("radix") * F.lit(groups) + F.col("grp"))
    return spread.sortWithinPartitions("radix", "grp", "first").mapInArrow(run, TOTAL_SCHEMA if last else LEVEL_SCHEMA)


def pair_totals(runs: DataFrame, n_runs: int, partitions: int, b_bits: int) -> DataFrame:
    """The written merge of all runs (TOTAL_SCHEMA), in as many levels as FAN_IN asks for."""
    level, kind = runs.where("radix >= 0").select("run", "radix", "first", "pairs", "docs"), "<u4"
    while n_runs > FAN_IN:
        groups = -(-n_runs // FAN_IN)
        level = materialize(merged_level(level, partitions, groups, kind, b_bits, False), "alignment-level")
        n_runs, kind = groups, "<i8"
    return materialize(merged_level(level, partitions, 1, kind, b_bits, True), "alignment-totals")


def counts_back(runs: DataFrame, totals: DataFrame, n_runs: int, partitions: int) -> DataFrame:
    """(run, radix, counts, best): for each run's block, in its order, the counts of its pairs."""
    salts = -(-n_runs // FAN_IN)
    none = F.lit(None)
    whole = totals.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"),
                          none.cast("bigint").alias("run"), "first", "pairs", "docs", "best")
    asked = runs.where("radix >= 0").select("radix", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt"),
                                            F.lit(1).alias("kind"), "run", "first", "pairs", none.cast("binary").alias("docs"),
                                            none.cast("binary").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, flat = None, [], None
        for key, row in _keyed(batches, 2):
            if key != now:
                now, held, flat = key, [], None
            if row["kind"] == 0:
                pairs, n = unpacked_pairs(row["pairs"]), unpacked(row["docs"], "<i8")
                held.append((pairs, n, np.unpackbits(unpacked(row["best"], "u1"), count=len(n))))
                continue
            if flat is None:
                flat = [np.concatenate(x) for x in zip(*held)]
            at = np.searchsorted(flat[0], unpacked_pairs(row["pairs"]))
            yield pa.record_batch([pa.array([row["run"]], pa.int64()), pa.array([key[0]], pa.int32()),
                                   pa.array([packed(flat[1][at])], pa.binary()), pa.array([packed(flat[2][at])], pa.binary())],
                                  names=["run", "radix", "counts", "best"])
    dealt = whole.unionByName(asked).repartitionById(partitions * salts, F.col("radix") * F.lit(salts) + F.col("salt"))
    return dealt.sortWithinPartitions("radix", "salt", "kind", "first").mapInArrow(
        run, "run bigint, radix int, counts binary, best binary")


def document_sums(runs: DataFrame, back: DataFrame, partitions: int) -> DataFrame:
    """One row per document, its links' counts added up in its run."""
    none = F.lit(None).cast("binary")
    own = runs.select("run", "radix", "docs", "members", "doc_ids", "tokens", "groups", none.alias("counts"), none.alias("best"))
    got = back.select("run", "radix", none.alias("docs"), none.alias("members"), F.lit(None).cast("array<bigint>").alias("doc_ids"),
                      F.lit(None).cast("array<bigint>").alias("tokens"), F.lit(None).cast("array<binary>").alias("groups"),
                      "counts", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = None

        def result() -> pa.RecordBatch:
            tokens = np.array(docs["tokens"], np.int64).reshape(-1, 4)
            columns = [pa.array(docs["doc_ids"], pa.int64()), *(pa.array(tokens[:, i]) for i in range(4)),
                       pa.array(best), pa.array(total), pa.array(docs["groups"], pa.binary())]
            return pa.record_batch(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
        for (_, radix), row in _keyed(batches, 2):
            if radix < 0:
                if docs is not None:
                    yield result()
                docs = row
                best, total = np.zeros(len(row["doc_ids"]), np.int64), np.zeros(len(row["doc_ids"]), np.int64)
            elif row["members"] is not None:
                per = unpacked(row["docs"], "<u4")
                held = unpacked(row["members"], "<u4").astype(np.int64)
                member, times = held[:len(held) // 2], held[len(held) // 2:]
            else:
                np.add.at(total, member, np.repeat(unpacked(row["counts"], "<i8"), per) * times)
                np.add.at(best, member, np.repeat(unpacked(row["best"], "u1").astype(np.int64), per) * times)
        if docs is not None:
            yield result()
    dealt = own.unionByName(got).repartition(partitions, "run")
    return dealt.sortWithinPartitions("run", "radix", F.col("members").isNull()).mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups binary")


class Alignment:
    """The alignment of a table's documents, as ``align`` makes it."""

    def __init__(self, runs: DataFrame, totals: DataFrame, n_runs: int, partitions: int, sides: Sides):
        self.runs, self.totals, self.n_runs, self.partitions, self.sides = runs, totals, n_runs, partitions, sides

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row per document row."""
        back = counts_back(self.runs, self.totals, self.n_runs, self.partitions)
        return document_sums(self.runs, back, shuffle_partitions(self.runs.sparkSession))

    def pairs(self) -> DataFrame:
        """(a_id, b_id, docs, best): every linked pair with its count, and whether it is its A id's highest."""
        sides = self.sides

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, row in _keyed(batches, 1):
                pairs, n = unpacked_pairs(row["pairs"]), unpacked(row["docs"], "<i8")
                a, b = sides.ids(pairs)
                best = np.unpackbits(unpacked(row["best"], "u1"), count=len(n)).astype(bool)
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(n), pa.array(best)], names=["a_id", "b_id", "docs", "best"])
        return self.totals.mapInArrow(run, "a_id bigint, b_id bigint, docs bigint, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str, run_bytes: int = RUN_BYTES, with_groups: bool = False) -> Alignment:
    """Align the documents of a table and count their linked pairs; runs and counts are written.

    Text that is null, empty, or that a side's tokens don't spell byte for byte
    has no tokens: all its numbers are 0 and its groups empty.  ``groups`` holds
    ``a1,a2|b1;a3|b2,b3`` where ``with_groups``, else its SHA-256.  Rows that repeat an id or a
    text are documents each.  A document longer than ``run_bytes`` is a run of its own.  Other
    columns are ignored, whatever their names; an empty table gives no rows."""
    partitions = min(shuffle_partitions(docs.sparkSession), RADIX_PARTITIONS)
    runs = document_runs(docs, a_path, b_path, partitions, run_bytes, with_groups)
    n_runs = max(1, runs.where("radix < 0").count())
    sides = Sides(pair_encoder(a_path, b_path))
    return Alignment(runs, pair_totals(runs, n_runs, partitions, sides.b_bits), n_runs, partitions, sides)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``align``'s documents with their groups' digest in hex, empty without tokens."""
    rows = align(docs, a_path, b_path).documents()
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.lower(F.hex("groups")).alias("groups_sha256"))
