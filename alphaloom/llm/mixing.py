"""Mixing sources to target weights with a low-discrepancy schedule.

Within a source the documents are shuffled (by a hash of their id) and laid
end to end; the stream is cut into blocks of equal word counts.  Slot t of the
schedule holds the golden-ratio point t * 0.618... mod 1 (64-bit integers, so no
rounding); mapped through the cumulative shares of the sources it names a
source, so any stretch of the schedule holds every source near its share.  The
slots of a source are ranked, rank r takes block r mod (blocks of the source) in
epoch r div (blocks), and the schedule is joined to the blocks.  Slots beyond
a source's need are void; the few that low discrepancy left short are
added at the end, and a source's last slot stops at its target, so each source takes its
target to the word.

Ranks and offsets are two-level prefix sums (per chunk or hash bucket, then
within), so a source with a third of all rows is spread over all tasks.  One
row per source comes to the driver, no documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_key, materialize, text_of

BLOCK_WORDS = 256
CHUNK_SLOTS = 1 << 16
BUCKETS = 1024                  # hash buckets of a source's shuffled documents
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0x9E3779B97F4A7C15     # fixed value: 2**64 divided by the golden ratio, odd


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("bigint")


def fill_targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of the total by weight; a share stops at MAX_REPEATS times its size
    and the excess is shared again by weight among the others."""
    total, capped = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest, w = total - sum(capped.values()), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > MAX_REPEATS * sizes[i]]
        if not over:
            return [float(capped[i]) if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        capped |= {i: MAX_REPEATS * sizes[i] for i in over}


def source_plan(rows: DataFrame, block_words: int) -> list[dict]:
    """One entry per source, in code point order and null last: its size,
    target, words to take, blocks in an epoch and slots."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    plan = []
    for no, (r, target) in enumerate(zip(found, targets)):
        size = r["size"]
        words = min(round(target), MAX_REPEATS * size)
        blocks = -(-size // block_words)
        epochs, rest = divmod(words, size) if size else (0, 0)
        plan.append({"source": r["source"], "no": no, "source_size": size, "target": target, "words": words,
                     "blocks": blocks, "slots": epochs * blocks - (-rest // block_words)})
    return plan


def thresholds(slots: list[int]) -> np.ndarray:
    """Ends of the sources' intervals in 64-bit points, in proportion to slots."""
    total, run, out = sum(slots), 0, []
    for n in slots:
        run += n
        out.append(min(run * (1 << 64) // total, (1 << 64) - 1))
    return np.array(out, np.uint64)


def slot_sources(first: int, count: int, ends: np.ndarray) -> np.ndarray:
    points = np.arange(first, first + count, dtype=np.uint64) * np.uint64(GOLDEN)
    return np.minimum(np.searchsorted(ends, points, side="right"), len(ends) - 1)


def schedule(spark, plan: list[dict], block_words: int) -> DataFrame:
    """(slot, source_no, epoch, block, words): every slot that takes words."""
    schema = "slot bigint, source_no int, epoch bigint, block bigint, words bigint"
    slots = [p["slots"] for p in plan]
    total = sum(slots)
    if not total:
        return spark.createDataFrame([], schema)
    ends, need = thresholds(slots), np.array(slots, np.int64)
    blocks = np.array([max(p["blocks"], 1) for p in plan], np.int64)
    size = np.array([p["source_size"] for p in plan], np.int64)
    words = np.array([p["words"] for p in plan], np.int64)
    chunks = -(-total // CHUNK_SLOTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                n = np.bincount(slot_sources(c * CHUNK_SLOTS, min(CHUNK_SLOTS, total - c * CHUNK_SLOTS), ends),
                                minlength=len(ends))
                yield pa.record_batch([pa.array([c] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()),
                                       pa.array(n, pa.int64())], names=["chunk", "source_no", "n"])

    def emit(slot, source, rank) -> pa.RecordBatch:
        used = rank < need[source]
        slot, source, rank = slot[used], source[used], rank[used]
        epoch, block = rank // blocks[source], rank % blocks[source]
        before = epoch * size[source] + block * block_words
        full = np.minimum(block_words, size[source] - block * block_words)
        taken = np.minimum(full, words[source] - before)
        return pa.record_batch([pa.array(slot, pa.int64()), pa.array(source, pa.int32()), pa.array(epoch, pa.int64()),
                                pa.array(block, pa.int64()), pa.array(taken, pa.int64())],
                               names=["slot", "source_no", "epoch", "block", "words"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["chunk"] * CHUNK_SLOTS
                source = slot_sources(first, min(CHUNK_SLOTS, total - first), ends)
                base = np.zeros(len(ends), np.int64)
                for s in row["bases"]:
                    base[s["source_no"]] = s["base"]
                order = np.argsort(source, kind="stable")
                own = source[order]
                start = np.searchsorted(own, np.arange(len(ends)))
                rank = np.empty(len(source), np.int64)
                rank[order] = np.arange(len(source)) - start[own] + base[own]
                yield emit(first + np.arange(len(source)), source, rank)

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)))

    ids = spark.range(chunks).select(F.col("id").alias("chunk"))
    counts = materialize(ids.mapInArrow(counted, "chunk bigint, source_no int, n bigint"), "slot-counts")
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = bases.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "base")).alias("bases"))
    main = bases.mapInArrow(ranked, schema)
    needs = spark.createDataFrame([(p["no"], p["slots"]) for p in plan], "source_no int, slots bigint")
    short = counts.groupBy("source_no").agg(F.sum("n").alias("n")).join(needs, "source_no").where("n < slots")
    short = short.select((F.lit(total) + F.col("source_no")).alias("slot"), "source_no",
                         F.explode(F.expr("sequence(n, slots - 1)")).alias("rank"))
    return main.unionByName(short.mapInArrow(closing, schema))


def laid_out(rows: DataFrame, plan: list[dict], seed: int, *own: str) -> DataFrame:
    """``rows`` (doc_id, source, size and the columns ``own``) with source_no,
    source_size, target and the word offset in the source's shuffled stream."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(p["source"], p["no"], p["source_size"], p["target"]) for p in plan],
                                  "name string, source_no int, source_size bigint, target double")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size", *own) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(inside)).join(sums, ["source_no", "bucket"])
    return placed.select("doc_id", "source", "size", *own, "source_no", "source_size", "target",
                         (F.col("base") + F.col("end") - F.col("size")).alias("offset"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, taken.

    Null, empty and wordless texts have size 0 and take nothing.  A null source
    is a source of its own.  Rows that repeat an id are documents each.  With no
    words at all every target is 0.  Reruns give the same rows."""
    return taken_words(sized(docs), block_words, seed)


def sized(docs: DataFrame, *own: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(text_of()).alias("size"), *own)


def taken_words(rows: DataFrame, block_words: int, seed: int, *own: str) -> DataFrame:
    """The mix of ``rows`` (doc_id, source, size and the columns ``own``, which stay)."""
    spark = rows.sparkSession
    rows = materialize(rows, "mix-sizes")
    plan = source_plan(rows, block_words)
    placed = materialize(laid_out(rows, plan, seed, *own), "mix-placed")
    slots = materialize(schedule(spark, plan, block_words), "mix-schedule")
    b = F.lit(block_words)
    length = F.least(b, F.col("source_size") - F.col("block") * b)
    sizes = spark.createDataFrame([(p["no"], p["source_size"]) for p in plan], "source_no int, source_size bigint")
    uses = slots.join(sizes, "source_no").withColumn("whole", F.col("words") == length).groupBy("source_no", "block") \
        .agg(F.sum(F.col("whole").cast("bigint")).alias("uses"),
             F.max(F.when(~F.col("whole"), F.col("words"))).alias("part"))
    filled = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b))))
    start, end = F.greatest("offset", F.col("block") * b), F.col("offset") + F.col("size")
    inside = F.least(end, (F.col("block") + 1) * b) - start
    partly = F.greatest(F.lit(0), F.least(end, F.col("block") * b + F.coalesce("part", F.lit(0))) - start)
    keys = ["doc_id", "source", "size", *own, "source_no", "source_size", "target", "offset"]
    taken = filled.join(uses, ["source_no", "block"], "left").groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("uses") * inside, F.lit(0)) + partly).alias("taken"))
    empty = placed.where("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(empty).select("doc_id", "source", "size", *own, "source_size", "target", "taken")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    last = next(islice(re.finditer(WORD, text), n - 1, None))
    return text[:last.end()]


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix as documents: a row is written once for each whole pass that
    takes it, and once more with its first words where the last pass stops
    inside it (n_chars then counts those).  Rows that the mix does not take,
    wordless ones among them, are left out.  Rows are told apart by id, source
    and text digest; rows that share all three are numbered, and each takes the
    words of one of them."""
    digest = F.unhex(F.sha2(text_of().cast("binary"), 256))
    taken = taken_words(sized(docs, digest.alias("digest")), block_words, seed, "digest")
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keys = ["__al_key", "__al_source", "__al_digest"]
    per = taken.groupBy(id_key().alias("__al_key"), source_key.alias("__al_source"), F.col("digest").alias("__al_digest")) \
        .agg(F.first("size").alias("__al_size"), F.sort_array(F.collect_list("taken"), asc=False).alias("__al_takes"))
    per = materialize(per.where(F.element_at("__al_takes", 1) > 0), "mix-taken")
    rows = docs.withColumns({"__al_key": id_key(), "__al_source": source_key, "__al_digest": digest}).join(per, keys)
    copy = F.lit(1)
    if not per.where(F.size("__al_takes") > 1).isEmpty():
        ties = [F.col("lang")] if "lang" in docs.columns else []
        copy = F.row_number().over(Window.partitionBy(*keys).orderBy(*ties or [F.lit(0)]))
    rows = rows.withColumn("__al_copy", copy).withColumn("__al_taken", F.element_at("__al_takes", F.col("__al_copy")))
    rows = rows.where("__al_taken > 0").select(
        *docs.columns, (F.col("__al_taken") / F.col("__al_size")).cast("bigint").alias("__al_whole"),
        (F.col("__al_taken") % F.col("__al_size")).alias("__al_rest"))
    names = docs.columns
    schema = StructType([f for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(len(names)).to_numpy(zero_copy_only=False)
            rest = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            own = batch.select(names)
            yield own.take(pa.array(np.repeat(np.arange(len(whole)), whole)))
            cut = np.flatnonzero(rest)
            if len(cut):
                part = own.take(pa.array(cut))
                texts = [first_words(t, n) for t, n in zip(part.column(names.index("text")).to_pylist(), rest[cut])]
                arrays = {c: part.column(c) for c in names}
                arrays["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in arrays:
                    arrays["n_chars"] = pa.array(list(map(len, texts)), part.schema.field("n_chars").type)
                yield pa.record_batch(list(arrays.values()), names=names)
    return rows.mapInArrow(run, schema)
