"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id and text, one of SLOTS for ever.  Spark adds up rows
and bytes per slot; what maps slots to shards is a table of SLOTS entries, kept as
one Parquet folder per version.  Rebalancing edits the last version: slots move
from full shards to emptier ones until the shards' bytes are near equal, every other slot
stays, and the edited map becomes the next version.  A new shard takes slots only into
itself; a shard that goes gives its slots away.

Only slot sums (SLOTS rows) reach the driver, and only the map (SLOTS rows) is broadcast.
Rows that repeat both id and text are added up before they are shuffled and dealt out in runs of
RUN_ROWS copies, each with a slot of its own, so one record that makes up a third of all rows fills no slot.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

SLOTS = 8192
RUN_ROWS = 64           # copies of one record that share a slot
CELL_ROWS = 50_000      # expected rows of a cell, the part of a slot that one window numbers
TOLERANCE = 0.0005      # shards that differ by this part of their mean are near equal
SEED = 11

MAP_SCHEMA = "version int, slot int, shard int, bytes bigint, rows bigint"


def record_size(column: str = "text") -> Column:
    """UTF-8 bytes of the text plus one."""
    return (F.octet_length(F.encode(text_of(column), "UTF-8")) + F.lit(1)).cast("bigint")


def record_hash(run: Column) -> Column:
    return F.xxhash64("doc_id", "size", "text_crc32", run, F.lit(SEED))


def slot_of(hashed: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, n): rows that agree in id and text, counted."""
    crc = F.crc32(F.encode(text_of(), "UTF-8")).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), record_size().alias("size"), crc.alias("text_crc32"))
    return rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))


def slotted(found: DataFrame, slots: int, cells: int = 1) -> DataFrame:
    """``records`` cut into runs of copies: with run, copies, hash, vslot and cell."""
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(RUN_ROWS))))
    rows = found.withColumn("run", run)
    rows = rows.withColumn("copies", F.least(F.lit(RUN_ROWS).cast("bigint"), F.col("n") - F.col("run") * RUN_ROWS))
    rows = rows.withColumn("hash", record_hash(F.col("run"))).withColumn("vslot", slot_of(F.col("hash"), slots))
    cell = F.pmod(F.floor(F.col("hash") / F.lit(slots)), F.lit(cells)).cast("int")
    return rows.withColumn("cell", cell).drop("n")


def slot_sums(rows: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of the slots that hold rows."""
    return rows.groupBy(F.col("vslot").alias("slot")).agg(
        F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


class SlotMap:
    """One version of the map: the shard of every slot, with the sums it was made for."""

    def __init__(self, version: int, shard: np.ndarray, size: np.ndarray, rows: np.ndarray):
        self.version, self.shard, self.size, self.rows = version, shard, size, rows

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots dealt in turn, before anything is known of their sizes."""
        return cls(0, np.arange(slots, dtype=np.int64) % shards, np.zeros(slots, np.int64), np.zeros(slots, np.int64))

    def with_sums(self, sums: DataFrame) -> SlotMap:
        """The same version with the slots' present sums (one row per slot to the driver)."""
        size, rows = np.zeros(len(self.shard), np.int64), np.zeros(len(self.shard), np.int64)
        for r in sums.collect():
            size[r["slot"]], rows[r["slot"]] = r["bytes"], r["rows"]
        return SlotMap(self.version, self.shard.copy(), size, rows)

    def totals(self, shards: int) -> np.ndarray:
        return np.bincount(self.shard, self.size, minlength=shards).astype(np.int64)

    def edited(self, shards: int, tolerance: float = TOLERANCE) -> SlotMap:
        """The next version for ``shards`` shards, changed in as few slots as balance needs.

        Slots of shards that are gone move first, largest first, each to the
        emptiest shard.  Where shards were added, the old ones give slots, and only to the new
        ones, until each new shard holds its share.  Where the number stays, the fullest
        shard gives the emptiest one a slot, or the two exchange one, as
        comes about closest to halving their difference (the smallest such slot), until they are near equal
        or nothing brings them closer."""
        old = int(self.shard.max()) + 1 if len(self.shard) else 0
        out = SlotMap(self.version + 1, self.shard.copy(), self.size, self.rows)
        gone = np.flatnonzero(out.shard >= shards)
        if len(gone):
            out._place(gone[np.argsort(-self.size[gone], kind="stable")], shards)
        if shards > old:
            out._grow(old, shards)
        else:
            out._level(shards, tolerance)
        return out

    def _place(self, loose: np.ndarray, shards: int) -> None:
        kept = np.bincount(self.shard[self.shard < shards], self.size[self.shard < shards], minlength=shards)
        heap = [(int(t), s) for s, t in enumerate(kept)]
        heapq.heapify(heap)
        for slot in loose:
            total, shard = heapq.heappop(heap)
            self.shard[slot] = shard
            heapq.heappush(heap, (total + int(self.size[slot]), shard))

    def _grow(self, old: int, shards: int) -> None:
        share = self.size.sum() / shards
        totals = self.totals(shards).astype(np.float64)
        for slot in np.argsort(-self.size, kind="stable"):
            giver, taker = self.shard[slot], old + int(np.argmin(totals[old:]))
            size = self.size[slot]
            if giver < old and size and totals[giver] - size >= share - size / 2 and totals[taker] + size <= share + size / 2:
                self.shard[slot] = taker
                totals[giver] -= size
                totals[taker] += size

    def _level(self, shards: int, tolerance: float) -> None:
        totals = self.totals(shards)
        near = tolerance * totals.mean() if shards else 0
        while shards > 1:
            full, least = int(np.argmax(totals)), int(np.argmin(totals))
            gap = int(totals[full] - totals[least])
            if gap <= near:
                return
            give, take = np.flatnonzero(self.shard == full), np.flatnonzero(self.shard == least)
            sizes = np.r_[np.int64(0), np.sort(self.size[take])]     # 0: nothing comes back
            order = np.argsort(self.size[take], kind="stable")
            wanted = 2 * (self.size[give] - gap / 2)                 # twice what should come back, to stay in halves
            at = np.searchsorted(2 * sizes, wanted)
            backs = np.concatenate([np.maximum(at - 1, 0), np.minimum(at, len(sizes) - 1)])
            gives = np.r_[give, give]
            left = np.abs(gap - 2 * (self.size[gives] - sizes[backs]))
            if left.min() >= gap:
                return
            good = np.flatnonzero(left <= max(near, min(2 * left.min(), gap - 1)))
            k = good[np.argmin(self.size[gives[good]])]              # of moves about as good, the smallest slot
            slot, back = gives[k], int(backs[k])
            moved = int(self.size[slot] - sizes[back])
            self.shard[slot] = least
            if back:
                self.shard[take[order[back - 1]]] = full
            totals[full] -= moved
            totals[least] += moved

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.shard)), self.shard.tolist(), self.size.tolist(), self.rows.tolist())
        return spark.createDataFrame([(self.version, *r) for r in rows], MAP_SCHEMA)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write a version beside the earlier ones; a version is never written twice."""
    slot_map.frame(spark).coalesce(1).drop("version").write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the last one if none is named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    found = sorted((r["slot"], r["shard"], r["bytes"], r["rows"]) for r in maps.where(F.col("version") == version).collect())
    if not found:
        raise ValueError(f"no version {version} in {path}")
    return SlotMap(version, *np.array(found, np.int64).T[1:])


def rebalance(spark: SparkSession, docs: DataFrame, path: str, shards: int) -> SlotMap:
    """Edit the last stored map for the present documents and store the next version."""
    old = load_map(spark, path)
    new = old.with_sums(slot_sums(slotted(records(docs), len(old.shard)))).edited(shards)
    save_map(spark, new, path)
    return new


def moved_bytes(old: SlotMap, new: SlotMap) -> int:
    """Bytes of the slots whose shard differs between two versions."""
    return int(new.size[old.shard != new.shard].sum())


def shard_documents(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``docs`` with a column ``shard``, to be written ``partitionBy("shard")``: a
    broadcast lookup of the map, no shuffle (unless records repeat more than RUN_ROWS times: those
    rows are told apart by where they stand in the input, so that their runs spread).  A column of
    that name is replaced; columns named ``__al_...`` are reserved; an empty table gives no rows."""
    spark = docs.sparkSession
    crc = F.crc32(F.encode(text_of(), "UTF-8")).cast("bigint")
    rows = docs.withColumns({"__al_id": F.col("doc_id").cast("bigint"), "__al_size": record_size(), "__al_crc": crc})
    many = records(docs).where(F.col("n") > RUN_ROWS)
    run = F.lit(0).cast("bigint")
    if not many.isEmpty():
        many = materialize(many.select(*(F.col(c).alias(f"__al_m_{c}") for c in many.columns)), "shard-repeats")
        hit = F.col("__al_id").eqNullSafe(F.col("__al_m_doc_id")) & (F.col("__al_size") == F.col("__al_m_size")) \
            & (F.col("__al_crc") == F.col("__al_m_text_crc32"))
        rows = rows.withColumn("__al_row", F.monotonically_increasing_id()).join(many, hit, "left")
        runs = F.floor((F.col("__al_m_n") - 1) / F.lit(RUN_ROWS)) + 1
        run = F.coalesce(F.pmod(F.xxhash64("__al_row"), runs), run)
    hashed = F.xxhash64("__al_id", "__al_size", "__al_crc", run, F.lit(SEED))
    lookup = slot_map.frame(spark).select(F.col("slot").alias("__al_slot"), F.col("shard").alias("__al_shard"))
    rows = rows.withColumn("__al_slot", slot_of(hashed, len(slot_map.shard))).join(F.broadcast(lookup), "__al_slot")
    return rows.select(*[c for c in docs.columns if c != "shard"], F.col("__al_shard").alias("shard"))


def place(docs: DataFrame, shards: int = 16, slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sizes are near equal.  Version 0 of the
    map deals the slots in turn, version 1 is edited to the bytes found in them (or ``slot_map`` is taken as it
    is).  ``slot`` numbers a shard's rows from 0 without a gap, in order of virtual slot and hash;
    ``grown_shard`` is null under this law.  Null and empty texts have size 1; a
    null id is an id like any other; rows that repeat id and text are rows each, and equal texts of other ids are
    not kept together.  A single text larger than a shard's share stays whole.  Other columns are ignored, whatever
    their names; an empty table gives no rows.  Reruns agree."""
    spark = docs.sparkSession
    found = materialize(records(docs), "shard-records")
    total = found.agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-total // (slots * CELL_ROWS)))
    rows = slotted(found, slots, cells)
    if slot_map is None:
        slot_map = SlotMap.first(shards, slots).with_sums(slot_sums(rows)).edited(shards)
    else:
        slot_map = slot_map.with_sums(slot_sums(rows))
    before = _rows_before(slot_map)
    lookup = spark.createDataFrame(
        [(i, int(s), int(b)) for i, (s, b) in enumerate(zip(slot_map.shard, before))], "vslot int, shard int, slot_base bigint")
    inside = Window.partitionBy("vslot", "cell").orderBy("hash", "doc_id", "size", "text_crc32", "run") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("upto", F.sum("copies").over(inside))
    if cells > 1:
        earlier = Window.partitionBy("vslot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cell_sums = rows.groupBy("vslot", "cell").agg(F.sum("copies").alias("cell_rows"))
        cell_sums = cell_sums.select("vslot", "cell", F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("cell_base"))
        numbered = numbered.join(cell_sums, ["vslot", "cell"])
    else:
        numbered = numbered.withColumn("cell_base", F.lit(0).cast("bigint"))
    placed = numbered.join(F.broadcast(lookup), "vslot")
    start = F.col("slot_base") + F.col("cell_base") + F.col("upto") - F.col("copies")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    return placed.withColumns({"start": start, "copy": copy}).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _rows_before(slot_map: SlotMap) -> np.ndarray:
    """Rows of the same shard in the slots before each slot."""
    order = np.argsort(slot_map.shard, kind="stable")
    shard, rows = slot_map.shard[order], slot_map.rows[order]
    before = np.cumsum(rows) - rows
    first = np.searchsorted(shard, shard)
    out = np.empty(len(rows), np.int64)
    out[order] = before - before[first]
    return out
