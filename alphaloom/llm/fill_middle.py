"""Fill-in-middle documents, cut through a sparse index of multibyte characters.

A document is cut twice, into prefix, middle and suffix, and written as sentinel,
part, sentinel, part, sentinel, part.  Texts stay UTF-8 buffers: a batch's index
records only its multibyte characters, each by its position (in code points and in bytes) and
the bytes it has beyond one, summed up.  One ``searchsorted`` over those positions
turns any number of byte cuts into code points or back; a text of ASCII
alone has no entry, and its conversions are plain differences.

Nothing is shuffled: a row's form and cuts depend on its id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
CHUNK_BYTES = 32 << 20          # text that is indexed at once


class MultibyteIndex:
    """Positions of the multibyte characters of a UTF-8 buffer.

    ``at`` holds the byte at which each starts, ``excess`` the bytes beyond one
    of all of them so far (one entry more than ``at``, from 0), ``nth`` their code points."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.r_[0, np.cumsum(own)]
        self.nth = self.at - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before these bytes, each the first of a character (or the end)."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """First bytes of these code points."""
        return char + self.excess[np.searchsorted(self.nth, char)]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets from 0) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _units(data: np.ndarray, offsets: np.ndarray, index: MultibyteIndex, unit: str):
    """(units per text, function from (text, units) to the byte where they end)."""
    if unit == "char":
        first = index.chars(offsets)
        return np.diff(first), lambda row, k: index.bytes(first[row] + k)
    if unit != "line":
        raise ValueError("unit is 'line' or 'char'")
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets)
    whole = np.diff(first)
    last = np.r_[np.uint8(10), data][offsets[1:]]               # the byte before each text's end
    n = whole + ((np.diff(offsets) > 0) & (last != 10))
    ends = np.r_[breaks, 0]

    def end(row, k):
        inner = ends[np.minimum(first[row] + np.maximum(k, 1) - 1, len(breaks))] + 1
        return np.where(k == 0, offsets[row], np.where(k > whole[row], offsets[row + 1], inner))
    return n, end


def fill_in_middle(docs: DataFrame, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50,
                   seed: int = 7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``unit`` is ``line`` (a line with its end) or ``char`` (a code point).  The first four
    unsigned 32-bit words of sha256("seed:doc_id") draw the two cuts (modulo n + 1), whether
    the document is transformed at all and its form: psm is prefix, suffix, middle;
    spm is suffix, prefix, middle.  An empty or null text, one that contains a
    sentinel, and one that the draw leaves out stay as they are (plain, lengths null).
    A null id is drawn as "null"; rows that repeat an id are cut by the same draw, each over its own text;
    a text over ``chunk_bytes`` is indexed alone.  Other columns are ignored, whatever their
    names; an empty table gives no rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_key()), 256)
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:
                limit = (ends[at - 1] if at else 0) + chunk_bytes
                stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
                yield _transformed(batch.slice(at, stop - at), unit, fim_percent, spm_percent)
                at = stop
    return rows.mapInArrow(run, FORM_SCHEMA)


def _transformed(batch: pa.RecordBatch, unit: str, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    texts = batch.column(1)
    data, offsets = _buffers(texts)
    index = MultibyteIndex(data)
    n, end = _units(data, offsets, index, unit)
    h = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
    cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    row = np.arange(len(n))
    first, second = end(row, cuts[0]), end(row, cuts[1])
    held = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = held | (np.diff(offsets) == 0) | (h[2] % 100 >= fim_percent)
    spm = h[3] % 100 < spm_percent
    char = index.chars(np.concatenate([offsets[:-1], first, second])).reshape(3, -1)
    view, out = memoryview(data), []
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for lo, a, b, hi, is_plain, is_spm in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(),
                                              plain.tolist(), spm.tolist()):
        if is_plain:
            out.append(view[lo:hi])
        elif is_spm:
            out.append(b"".join((s, view[b:hi], p, view[lo:a], m, view[a:b])))
        else:
            out.append(b"".join((p, view[lo:a], s, view[b:hi], m, view[a:b])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.record_batch(
        [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(char[1] - char[0], pa.int64(), mask=plain),
         pa.array(char[2] - char[1], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored_text(output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from the output and its form alone.  A transformed
    output holds each sentinel exactly once, so splitting at them is exact."""
    out = F.col(output)

    def between(left: str, right: str | None) -> Column:
        part = F.split_part(out, F.lit(left), F.lit(2))
        return F.split_part(part, F.lit(right), F.lit(1)) if right else part
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def cut_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` over lines with the digests of its output and of the restored
    text in place of the output; same rows and rules."""
    rows = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored_text()).alias("restored_sha256"))
