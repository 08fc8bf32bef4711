"""SimHash near-dedup over a byte-position inverted index.

A 64-bit fingerprint has eight byte positions.  Fingerprints that differ in at
most d bits (d = 3) agree in at least 8 - d of them, so the filter tallies
the positions at which two fingerprints hold the same byte, retains pairs that
reach 8 - d, and verifies those by their bit distance.

Posting lists of single bytes would each hold 1/256 of all fingerprints, and
every pair in a list would have to be tallied.  The lists here are keyed by three
positions of one half: five shared positions of eight put at least three into
one half, so every pair that can pass meets in one of the 2 x 4 lists of its
halves, and a list holds about 1/2^24 of the fingerprints.  Only distinct
fingerprints are indexed (copies share a row).  A list longer than
``LIST_ROWS`` is dealt in blocks, one bucket for each pair of blocks, so no
task gets more than two blocks of it and no pair is lost.  A bucket emits a star for
each of its connected sets rather than all its pairs; the sets are joined by
``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialize, text_of
from .components import components
from .exact_mph import keep_rows

LIST_ROWS = 1024
SEED = 42
CHUNK = 1 << 16


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of a text in UTF-8: XXH64 (seed 42) of every word shingle,
    repeats included; a bit is set if it is set in over half of the hashes.
    Only A-Z are lower-cased; no words give zero."""
    import xxhash

    words = data.lower().split()            # bytes: splits at x20 and x09-x0D, lowers A-Z
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    span = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(words) - span
    for at in range(0, total, CHUNK):
        stop = min(total, at + CHUNK)
        hashes = np.array([digest(joined[s:e - 1], SEED)
                           for s, e in zip(starts[at:stop], ends[at + span:stop + span])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > total, bitorder="little")
    return int.from_bytes(packed.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp): one row per document row; with ``digest`` also its text's SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            fps = [fingerprint(x.as_py(), shingle) for x in data]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]],
                                  names=["doc_id", "fp", "digest"][:batch.num_columns])
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")]
    if digest:
        columns.append(F.sha2(text_of().cast("binary"), 256).alias("digest"))
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, fp bigint" + (", digest string" if digest else ""))


def posting_keys(max_distance: int) -> list[tuple[int, ...]]:
    """Byte positions of the posting lists: each half's subsets of the size that
    any pair passing the count filter must share in one half."""
    least = 8 - max_distance
    size = max(1, -(-least // 2))
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, size)]


def star_links(fps: np.ndarray, lists: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal ``lists`` (sorted), as stars: for
    each connected set of a list, every member and its smallest member."""
    n = len(fps)
    least = 8 - max_distance
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    out_a, out_b = [], []

    def passing(i: np.ndarray, j: np.ndarray) -> None:
        x = fps[i] ^ fps[j]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        x_ok = tally >= least
        i, j, x = i[x_ok], j[x_ok], x[x_ok]
        near = np.bitwise_count(x) <= max_distance
        out_a.append(i[near])
        out_b.append(j[near])

    group = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[group] <= 32
    for d in range(1, 32):
        i = np.arange(n - d)
        i = i[small[:n - d] & (group[:n - d] == group[d:])] if n > d else i[:0]
        if not len(i):
            break
        passing(i, i + d)
    for s, m in zip(starts[sizes > 32], sizes[sizes > 32]):
        whole = np.arange(s, s + m)
        for at in range(s, s + m, 256):
            rows = np.arange(at, min(at + 256, s + m))
            i, j = np.repeat(rows, m), np.tile(whole, len(rows))
            up = i < j
            passing(i[up], j[up])
    a, b = np.concatenate([*out_a, np.zeros(0, np.int64)]), np.concatenate([*out_b, np.zeros(0, np.int64)])
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _link_lists(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_list = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def linked(fps, lists):
            a, b = star_links(fps, lists, max_distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        last, number = None, 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)], axis=1)
            if not len(fps):
                continue
            new = np.r_[last is None or bool((keys[0] != last).any()), (keys[1:] != keys[:-1]).any(axis=1)]
            lists = number + np.cumsum(new)
            last, number = keys[-1], int(lists[-1])
            fps, lists = np.concatenate([held_fp, fps]), np.concatenate([held_list, lists])
            cut = int(np.searchsorted(lists, number))       # the last list may go on in the next batch
            if cut:
                yield linked(fps[:cut], lists[:cut])
            held_fp, held_list = fps[cut:], lists[cut:]
        if len(held_fp):
            yield linked(held_fp, held_list)
    return run


def near_links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``.  They connect exactly
    the fingerprints that chains of ``max_distance``-bit links connect."""
    def key(at, positions):
        value = F.lit(at).cast("bigint")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftright(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)))
        return value

    lists = [key(at, c) for at, c in enumerate(posting_keys(max_distance))]
    posts = fps.select("fp", F.explode(F.array(*lists)).alias("list"))
    lengths = posts.groupBy("list").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    blocks = F.ceil(F.col("len") / F.lit(LIST_ROWS)).cast("bigint")
    posts = posts.join(lengths, "list").withColumn("blocks", blocks)
    posts = posts.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    posts = posts.select("fp", "list", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = posts.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    return dealt.mapInArrow(_link_lists(max_distance), "a bigint, b bigint")


def rooted(distinct: DataFrame, max_distance: int) -> DataFrame:
    """``distinct`` (one row per fingerprint ``fp``) with the root of its component."""
    roots = components(near_links(distinct.select("fp"), max_distance))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per document row: doc_id, fp, component_id (smallest doc_id
    reachable over links).  Null, empty and wordless texts have fingerprint
    zero and link like any other; a text shorter than a shingle is one shingle.
    Rows that repeat an id each get a row; null ids are never the smallest
    unless a component has no other.  Other columns are ignored."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp")
    named = rooted(distinct, max_distance)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id
    (null ids last), and of rows that share it the one whose text has the least
    digest.  Components are told apart by their fingerprints, not by ids, so
    unrelated texts that repeat an id or have none all stay."""
    rows = materialize(fingerprints(docs, shingle, digest=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fp")
    first = rooted(distinct, max_distance).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    kept = first.select(id_key().alias("__al_key"), F.col("digest").alias("__al_digest"))
    return keep_rows(docs.withColumn("__al_digest", F.sha2(text_of().cast("binary"), 256)), kept)
