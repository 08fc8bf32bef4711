"""Exact dedup against a minimal perfect hash over historical digests.

An index is built over the distinct SHA-256 digests of texts seen earlier.
Digests are dealt to shards by their leading bytes; each shard becomes a
minimal perfect hash (hash and displace): a bucket's pilot sends its keys to
free slots, and n keys fill exactly n slots.  A slot holds the full digest,
the winner's locator (its doc_id) and the number of rows seen.  A new digest is
looked up by two equi-joins (bucket to pilot, slot to digest) and counts as a
repeat only if all 32 bytes agree with the slot; the rest are not members and
are grouped among themselves.

Every shuffle carries digests, never texts, and rows are aggregated per
digest before they are shuffled, so a text that makes up a third of all rows
is one key.  The last join back to the rows is a plain equi-join whose row
side adaptive execution can split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialize, text_of

KEYS_PER_SHARD = 16384      # expected; SHA-256 spreads keys evenly, so a shard stays near it
KEYS_PER_BUCKET = 4
HASH_SEED = 42              # fixed value: seed of Spark's xxhash64

INDEX_SCHEMA = ("kind int, shard bigint, pos bigint, n bigint, pilot int, "
                "digest binary, winner bigint, members bigint")


def _word(at: int) -> Column:
    """Four digest bytes from ``at`` (1-based) as an unsigned number."""
    return F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("bigint")


def digest_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n): rows of one id and text count once with n copies."""
    digest = F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest")
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest)
            .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")))


def digest_groups(counts: DataFrame) -> DataFrame:
    """(digest, winner, members): the largest id stays."""
    return counts.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("members"))


def place_keys(digests: list[bytes], buckets: int) -> tuple[list[int], dict[int, int]]:
    """Slots of the keys and pilots of the non-empty buckets of one shard.

    Larger buckets are placed first by trying pilots until all their keys land
    on free slots; a bucket of one key takes a free slot directly, written as
    a negative pilot."""
    import xxhash

    n = len(digests)
    base = [xxhash.xxh64_intdigest(d, HASH_SEED) for d in digests]
    by_bucket: dict[int, list[int]] = {}
    for i, d in enumerate(digests):
        by_bucket.setdefault(int.from_bytes(d[4:8], "big") % buckets, []).append(i)
    taken, slot, pilots = bytearray(n), [0] * n, {}
    order = sorted(by_bucket, key=lambda b: (-len(by_bucket[b]), b))
    singles = []
    for b in order:
        keys = by_bucket[b]
        if len(keys) == 1:
            singles.append(b)
            continue
        for pilot in range(1 << 30):
            raw = pilot.to_bytes(4, "little")
            spots = []
            for i in keys:
                h = xxhash.xxh64_intdigest(raw, base[i])
                p = (h - (1 << 64) if h >> 63 else h) % n
                if taken[p] or p in spots:
                    break
                spots.append(p)
            else:
                break
        else:
            raise RuntimeError("no pilot places this bucket")
        pilots[b] = pilot
        for i, p in zip(keys, spots):
            slot[i] = p
            taken[p] = 1
    free = (p for p in range(n) if not taken[p])
    for b in singles:
        p = next(free)
        pilots[b] = -p - 1
        slot[by_bucket[b][0]] = p
    return slot, pilots


def _shard_builder(buckets: int):
    def build(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        digests = group.column("digest").to_pylist()
        n = len(digests)
        slot, pilots = place_keys(digests, buckets)
        b = list(pilots)
        m = len(b)
        return pa.table({
            "kind": pa.array([0] * m + [1] * n, pa.int32()),
            "shard": pa.array([shard] * (m + n), pa.int64()),
            "pos": pa.array(b + slot, pa.int64()),
            "n": pa.array([n] * (m + n), pa.int64()),
            "pilot": pa.array([pilots[x] for x in b] + [0] * n, pa.int32()),
            "digest": pa.array([None] * m + digests, pa.binary()),
            "winner": pa.array([None] * m + group.column("winner").to_pylist(), pa.int64()),
            "members": pa.array([None] * m + group.column("members").to_pylist(), pa.int64()),
        })
    return build


class DigestIndex:
    """A written index: ``pilots`` (kind 0) and ``slots`` (kind 1)."""

    def __init__(self, frame: DataFrame, shards: int, buckets: int):
        self.frame, self.shards, self.buckets = frame, shards, buckets

    def shard(self) -> Column:
        return (_word(1) % F.lit(self.shards)).alias("shard")

    def bucket(self) -> Column:
        return (_word(5) % F.lit(self.buckets)).alias("bucket")

    def pilots(self) -> DataFrame:
        return self.frame.where("kind = 0").select("shard", F.col("pos").alias("bucket"), "pilot", "n")

    def slots(self) -> DataFrame:
        return self.frame.where("kind = 1").select(
            "shard", "pos", F.col("digest").alias("slot_digest"), "winner", F.col("members").alias("seen"))


def build_index(groups: DataFrame, at_most: int) -> DigestIndex:
    """Index distinct digests (``digest``, ``winner``, ``members``).
    ``at_most`` is an upper bound of their number; it sizes the shards."""
    shards = max(1, -(-at_most // KEYS_PER_SHARD))
    buckets = max(1, -(-at_most // (shards * KEYS_PER_BUCKET)))
    index = DigestIndex(None, shards, buckets)
    frame = (groups.withColumn("shard", index.shard()).groupBy("shard")
             .applyInArrow(_shard_builder(buckets), INDEX_SCHEMA))
    index.frame = materialize(frame, "digest-index")
    return index


def lookup(groups: DataFrame, index: DigestIndex) -> DataFrame:
    """Each distinct digest with its slot (``shard``, ``pos``) if all its bytes
    are those in the slot, else with a null ``pos``."""
    probe = groups.withColumns({"shard": index.shard(), "bucket": index.bucket()})
    placed = probe.join(index.pilots(), ["shard", "bucket"], "left").withColumn(
        "pos", F.expr("CASE WHEN pilot < 0 THEN cast(-pilot - 1 AS bigint) "
                      "ELSE pmod(xxhash64(digest, pilot), n) END"))
    found = placed.join(index.slots().select("shard", "pos", "slot_digest"), ["shard", "pos"], "left")
    hit = F.col("slot_digest") == F.col("digest")
    return found.select("digest", F.col("winner").alias("new_winner"), F.col("members").alias("new_members"),
                        "shard", F.when(hit, F.col("pos")).alias("pos"))


def merge_groups(new_groups: DataFrame, index: DigestIndex) -> DataFrame:
    """(digest, keep_id, group_size) over history and new rows together."""
    found = materialize(lookup(new_groups, index), "digest-lookup")
    members = found.where("pos IS NOT NULL").select("shard", "pos", "new_winner", "new_members")
    known = index.slots().join(members, ["shard", "pos"], "left").select(
        F.col("slot_digest").alias("digest"), F.greatest("winner", "new_winner").alias("keep_id"),
        (F.col("seen") + F.coalesce("new_members", F.lit(0))).alias("group_size"))
    others = found.where("pos IS NULL").select(
        "digest", F.col("new_winner").alias("keep_id"), F.col("new_members").alias("group_size"))
    return known.unionByName(others)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    The older half of the id range is the history that the index is built on;
    the newer half is looked up in it.  Null and empty texts are one group.
    Of rows that repeat both id and text, one is kept.  A null id counts as
    smaller than any other and belongs to the newer half.  Other columns are
    ignored; an empty table gives no rows."""
    counts = materialize(digest_counts(docs), "digest-counts")
    low, high, rows = counts.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    older = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    index = build_index(digest_groups(counts.where(older)), rows)
    groups = merge_groups(digest_groups(counts.where(~older)), index)
    rows = counts.join(groups, "digest")
    copy = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")
    rows = rows.select("doc_id", "keep_id", "group_size", "digest", copy)
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(id_key().alias("__al_key"), F.col("text_sha256").alias("__al_digest"))
    return keep_rows(docs.withColumn("__al_digest", F.sha2(text_of().cast("binary"), 256)), kept)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with ``__al_digest``) named in ``kept`` (__al_key, __al_digest),
    one for each pair: repeats of a row are cut to the first by lang and source."""
    from pyspark.sql import Window

    columns = [c for c in docs.columns if c != "__al_digest"]
    ties = [F.col(c) for c in ("lang", "source") if c in columns]
    once = Window.partitionBy("__al_key", "__al_digest").orderBy(*ties or [F.lit(0)])
    rows = docs.withColumn("__al_key", id_key()).join(kept, ["__al_key", "__al_digest"], "left_semi")
    return rows.withColumn("__al_copy", F.row_number().over(once)).where("__al_copy = 1").select(*columns)
