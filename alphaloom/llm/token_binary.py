"""Token ids as canonical length-limited Huffman codes in block files.

The ids of all documents are counted once; the counts (one per vocabulary
entry) give code lengths of at most 16 bits by package-merge, and the lengths
alone fix the canonical code.  Documents are dealt to files by ranges of
doc_id and sorted inside, so the files hold the documents in ascending order.  A
file is a Parquet file of independent blocks: a block holds whole documents,
their ids' bits, and the bit offset of every 256th id.  A reader decodes all
checkpoints of a block side by side with one table of 2^16 entries.

Ids are encoded once, written as a table (so nothing is encoded again after a
lost executor) and shuffled once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import scratch_path

from .common import materialize, shuffle_partitions, text_of
from .tokens import binary_rows, encoder, id_type, with_end

END_ID = 2
MAX_BITS = 16
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ids with a count
    (package-merge); 0 for ids without one."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[order].astype(np.float64)
    weights, leaves_upto = leaf, []
    for _ in range(limit - 1):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        rank = np.argsort(merged, kind="stable")
        weights = merged[rank]
        leaves_upto.append(np.cumsum(rank < n))         # leaves among the first i + 1 items
    take = 2 * n - 2
    per_leaf = np.zeros(n + 1, np.int64)
    for upto in reversed(leaves_upto):
        leaves = int(upto[take - 1]) if take else 0
        per_leaf[0] += 1
        per_leaf[leaves] -= 1
        take = 2 * (take - leaves)
    per_leaf[0] += 1
    per_leaf[take] -= 1
    lengths[order] = np.cumsum(per_leaf)[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for s in order[lengths[order] > 0]:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every 16-bit window."""
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.uint8)
    total = int(span.sum())
    assert (codes[order] << (MAX_BITS - lengths[order].astype(np.int64)) == np.cumsum(span) - span).all()
    ids[:total], sizes[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    value = codes[ids] << (24 - size - (at & 7))
    byte = at >> 3
    n = int(ends[-1] + 7 >> 3) + 3
    out = sum(np.bincount(byte + k, (value >> (16 - 8 * k)) & 255, minlength=n) for k in range(3))
    return out.astype(np.uint8)[:n - 3].tobytes(), at[::CHECKPOINT]


def decode_block(payload: bytes, checkpoints: np.ndarray, n: int, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block; all checkpoints advance side by side."""
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.int32)
    wide = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = checkpoints.astype(np.int64)
    out = np.empty((CHECKPOINT, len(at)), np.int32)
    last = len(wide) - 1
    for k in range(CHECKPOINT):
        window = (wide[np.minimum(at >> 3, last)] >> (8 - (at & 7))) & 0xFFFF
        out[k] = ids[window]
        at = at + sizes[window]
    return out.T.ravel()[:n]


BLOCK_SCHEMA = ("part int, block int, start bigint, tokens bigint, doc_ids array<bigint>, "
                "doc_tokens array<bigint>, checkpoints array<bigint>, payload binary")


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Upper ends of ``parts`` ranges of doc_id of about equal row counts."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), cuts, 100 * parts)).first()[0]
    return sorted(set(found or []))


def token_table(docs: DataFrame, vocabulary: str, end_id: int, bounds: list[int], kind: str) -> DataFrame:
    """(part, doc_id, n, ids): part is the range of doc_id, null ids in the first."""
    ends = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            lowest = np.iinfo(np.int64).min
            part = np.searchsorted(ends, batch.column(0).fill_null(lowest).to_numpy(zero_copy_only=False), side="left")
            for at, ids, counts in coder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                m = len(counts)
                yield pa.record_batch([pa.array(part[at:at + m], pa.int32()), batch.column(0).slice(at, m), pa.array(counts),
                                       binary_rows(ids.astype(kind), counts)], names=["part", "doc_id", "n", "ids"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "part int, doc_id bigint, n bigint, ids binary")


def flat_ids(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column, end to end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind)


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(flat_ids(batch.column(0), kind), minlength=len(total))
            got[:len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])
    rows = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write ``path``/blocks and ``path``/code for all documents."""
    spark = docs.sparkSession
    kind = id_type(vocabulary)
    parts = shuffle_partitions(spark)
    tokens = materialize(token_table(docs, vocabulary, end_id, range_bounds(docs, parts), kind), "token-ids",
                         compression="zstd")
    lengths = code_lengths(id_counts(tokens, kind))
    codes = canonical_codes(lengths)
    starts, run_total = {}, 0
    for part, n in sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[part] = run_total
        run_total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, held_n, block, part, start = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, held_n, block, start
            payload, marks = encode_block(np.concatenate(ids), lengths, codes)
            row = {"part": part, "block": block, "start": start, "tokens": held_n, "doc_ids": [d for d, _ in held],
                   "doc_tokens": [n for _, n in held], "checkpoints": marks.tolist(), "payload": payload}
            held, ids, start, held_n, block = [], [], start + held_n, 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema)

        arrow_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()),
                                  ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                                  ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
        opened = False
        for batch in batches:
            if not opened and batch.num_rows:
                part = batch.column(0)[0].as_py()
                start, opened = starts[part], True
            for doc_id, n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                held.append((doc_id, n))
                ids.append(np.frombuffer(blob.as_buffer(), kind))
                held_n += n
                if held_n >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()
    dealt = tokens.repartitionById(parts, F.col("part")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "n", "ids")
    dealt.mapInArrow(run, BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(used.tolist(), lengths[used].tolist())], "ids array<int>, lengths array<int>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/code")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files, one row per document."""
    code = spark.read.parquet(f"{path}/code").first()
    lengths = np.zeros(max(code.ids, default=0) + 1, np.uint8)
    lengths[code.ids] = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sizes = decode_tables(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], np.array(row["checkpoints"]), row["tokens"], ids_of, sizes).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                spans = list(zip((ends - row["doc_tokens"]).tolist(), ends.tolist()))
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + a for a, _ in spans], pa.int64()),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()),
                        pa.array([ids[a:b].tobytes() if with_ids else None for a, b in spans], pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    found = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return found if with_ids else found.drop("ids")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the files into the shared folder and return what reading them gives,
    without the ids.  Null and empty texts are the end id alone; a null doc_id
    comes first; rows that repeat an id are documents each, shorter first.
    Other columns are ignored; an empty table gives no rows."""
    path = scratch_path(docs.sparkSession, f"token-files-{uuid.uuid4().hex}")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)
