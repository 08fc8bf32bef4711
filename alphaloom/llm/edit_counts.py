"""Edit-aware token counts over per-document segment trees.

A document is kept as leaves, runs of about ``LEAF_TOKENS`` whole tokens, under a
balanced tree whose nodes sum characters, tokens and leaves.  Leaves are cut at
the ends of pre-tokens (also between letters, digits and signs without a space), and
inside a pre-token that is longer than a leaf at the ends of its tokens, so a text
without a single space has leaves as well.  A leaf encoded alone gives
its part of the tokens of the whole text.

An edit descends the tree to the leaves it touches and encodes them with one
leaf of context on each side.  If the outermost ``ANCHOR`` tokens of both contexts come out
as they were, everything beyond is unchanged too: a token sequence is a byte-pair
encoding if each two neighbours are, and the neighbours on the far side were not
touched.  Otherwise the context is doubled (a long run of one character may shift
to its end).  The encoded region is cut into new leaves, as many as it needs, which
take the place of the old ones; sums change along the path to the root only, and a
tree that has become too deep is balanced again without encoding.

The trees are a table (one row per document: leaves and their token counts), so
later edits start from it and never encode a whole text again.  Building and editing
are maps over rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .secrets import tiktoken_encoding

LEAF_TOKENS = 64
ANCHOR = 16                     # outermost tokens of a context (all, if fewer) that must not change
CONTEXT = 8                     # characters that a context has at least

TREE_SCHEMA = "doc_id bigint, leaves array<string>, tokens array<int>"
EDITS_TYPE = "array<struct<pos:bigint,drop:bigint,insert:string>>"


def separable(text: str, at: int) -> bool:
    """Whether a text may be cut at ``at``, the end of one of its tokens, so that both
    parts split into the pre-tokens, or parts of pre-tokens, of the whole.

    A space belongs to the word after it and the last character of longer white
    space stands apart, so no cut comes right after a single space or before the last two of
    a run; an apostrophe may open a contraction, so none touches one."""
    a, b, c = text[at - 1], text[at], text[at + 1:at + 2]
    if a == "'" or b == "'":
        return False
    if b.isspace():
        return c != "" and c.isspace() == a.isspace() and (a.isspace() or b == " ")
    return not a.isspace()


class Encoder:
    """Tokens of texts under one vocabulary, with their ends in characters."""

    def __init__(self, vocabulary: str):
        self.encoding = tiktoken_encoding(vocabulary)
        self.bytes = np.zeros(self.encoding.n_vocab, np.int64)
        for token in range(self.encoding.n_vocab):
            try:
                self.bytes[token] = len(self.encoding.decode_single_token_bytes(token))
            except KeyError:                            # a number that the vocabulary leaves out
                pass

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def ends(self, text: str, ids: list[int]) -> np.ndarray:
        """Characters before each token's end; -1 where it lies inside a character."""
        ends = np.cumsum(self.bytes[ids])
        if text.isascii():
            return ends
        data = np.frombuffer(text.encode(), np.uint8)
        first = (data & 0xC0) != 0x80
        place = np.where(first, np.cumsum(first) - 1, -1)
        return np.r_[place, len(text)][ends]

    def cut(self, text: str, ids: list[int]) -> list[tuple[str, int]]:
        """The text as leaves (text, tokens): the first permitted cut after ``LEAF_TOKENS`` tokens."""
        out, at, done = [], 0, 0
        ends = self.ends(text, ids).tolist()
        i = LEAF_TOKENS
        while i < len(ids):                             # token i would open a leaf
            cut = ends[i - 1]
            if cut > at and cut < len(text) and separable(text, cut):
                out.append((text[at:cut], i - done))
                at, done = cut, i
                i += LEAF_TOKENS
            else:
                i += 1
        return [*out, (text[at:], len(ids) - done)]

    def leaves(self, text: str) -> list[tuple[str, int]]:
        return self.cut(text, self.ids(text))


class Node:
    """A leaf (with its text) or the sums of two subtrees."""

    __slots__ = ("chars", "depth", "left", "right", "size", "text", "tokens")

    def __init__(self, text: str | None, tokens: int, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.chars, self.tokens, self.size, self.depth = len(text), tokens, 1, 0
        else:
            self.chars = left.chars + right.chars
            self.tokens = left.tokens + right.tokens
            self.size = left.size + right.size
            self.depth = 1 + max(left.depth, right.depth)


def balanced(leaves: list[tuple[str, int]]) -> Node | None:
    nodes = [Node(*leaf) for leaf in leaves]
    while len(nodes) > 1:
        pairs = [Node(None, 0, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = pairs + nodes[2 * len(pairs):]
    return nodes[0] if nodes else None


def spliced(node: Node, first: int, stop: int, new: Node | None) -> Node | None:
    """The tree with leaves ``first`` to ``stop`` (exclusive, at least one) replaced by ``new``."""
    if first <= 0 and stop >= node.size:
        return new
    middle = node.left.size
    left, right = node.left, node.right
    if first < middle:
        left = spliced(left, first, min(stop, middle), new)
        new = None
    if stop > middle:
        right = spliced(right, max(first - middle, 0), stop - middle, new)
    if left is None or right is None:
        return left or right
    return Node(None, 0, left, right)


class SegmentTree:
    """Leaves of a document with sums of characters and tokens."""

    def __init__(self, leaves: list[tuple[str, int]]):
        self.root = balanced(leaves or [("", 0)])

    @property
    def chars(self) -> int:
        return self.root.chars

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def leaves(self, first: int = 0, stop: int | None = None) -> list[tuple[str, int]]:
        """The leaves from ``first`` to ``stop`` in order."""
        out: list[tuple[str, int]] = []
        stop = self.root.size if stop is None else stop
        todo = [(self.root, 0)]
        while todo:
            node, at = todo.pop()
            if at >= stop or at + node.size <= first:
                continue
            if node.left is None:
                out.append((node.text, node.tokens))
            else:
                todo += [(node.right, at + node.left.size), (node.left, at)]
        return out

    def find(self, at: int) -> tuple[int, int]:
        """Number and start of the leaf that holds character ``at`` (the last leaf, from the end on)."""
        node, leaf, start = self.root, 0, 0
        while node.left is not None:
            if at < start + node.left.chars:
                node = node.left
            else:
                leaf, start, node = leaf + node.left.size, start + node.left.chars, node.right
        return leaf, start

    def context(self, edge: int, step: int, leaves: int) -> tuple[int, str]:
        """At least ``leaves`` leaves and ``CONTEXT`` characters before (step -1) leaf
        number ``edge`` or from it on (step 1), as far as there are any: the other edge, and the text."""
        far, texts, chars = edge, [], 0
        while (far > 0 if step < 0 else far < self.root.size) and (abs(far - edge) < leaves or chars < CONTEXT):
            more = (max(far - leaves, 0), far) if step < 0 else (far, min(far + leaves, self.root.size))
            found = [text for text, _ in self.leaves(*more)]
            texts = found + texts if step < 0 else texts + found
            chars += sum(map(len, found))
            far = more[0] if step < 0 else more[1]
        return far, "".join(texts)

    def edit(self, pos: int, drop: int, insert: str, encoder: Encoder) -> int:
        """Replace ``drop`` characters at ``pos`` by ``insert``.  Returns the number of
        tokens encoded for it, context included."""
        pos = min(max(pos, 0), self.chars)
        end = min(pos + max(drop, 0), self.chars)
        first, start = self.find(pos)
        last, last_start = self.find(max(end - 1, pos))
        old = "".join(text for text, _ in self.leaves(first, last + 1))
        middle = old[:pos - start] + insert + old[end - start:]
        again, before, after = 0, 1, 1
        while True:
            low, left = self.context(first, -1, before)
            high, right = self.context(last + 1, 1, after)
            text = left + middle + right
            ids = encoder.ids(text)
            lead = encoder.ids(left) if low else []             # nothing lies beyond the ends of a text
            tail = encoder.ids(right) if high < self.root.size else []
            again += len(ids) + len(lead) + len(tail)
            lead, tail = lead[:ANCHOR], tail[-ANCHOR:]
            fits = (ids[:len(lead)] == lead, ids[len(ids) - len(tail):] == tail)
            if all(fits) and len(lead) + len(tail) <= len(ids):
                break
            before, after = before * (1 if fits[0] and not fits[1] else 2), after * (1 if fits[1] and not fits[0] else 2)
        new = encoder.cut(text, ids) if text else []
        self.root = spliced(self.root, low, high, balanced(new)) or Node("", 0)
        if self.root.depth > 2 * self.root.size.bit_length() + 8:
            self.root = balanced(self.leaves())
        return again


def build_trees(docs: DataFrame, vocabulary: str, edits: Column | None = None) -> DataFrame:
    """Tree rows (doc_id, leaves, tokens[, edits]) of whole texts of any length.

    Null and empty texts are one empty leaf, an empty table gives no rows, rows that repeat
    an id are documents each, other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                leaves = [encoder.leaves(x.as_py()) for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array([[t for t, _ in own] for own in leaves], pa.list_(pa.string())),
                                       pa.array([[n for _, n in own] for own in leaves], pa.list_(pa.int32())), *part.columns[2:]],
                                      names=["doc_id", "leaves", "tokens", "edits"][:part.num_columns + 1])
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")]
    if edits is not None:
        columns.append(edits.cast(EDITS_TYPE).alias("edits"))
    schema = TREE_SCHEMA + (f", edits {EDITS_TYPE}" if edits is not None else "")
    return docs.select(*columns).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Edited trees with counts: doc_id, leaves, tokens, n_edits, n_before, n_after, n_reencoded.

    ``edits`` (pos, drop, insert) apply in order; a position counts code points of
    the text as the edits before left it and is cut to its ends; null
    edits, positions, lengths and texts count as none, 0, 0 and empty; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for r in batch.slice(at, 1000).to_pylist():
                    tree = SegmentTree(list(zip(r["leaves"], r["tokens"])))
                    edits = [e for e in r["edits"] or [] if e is not None]
                    before, again = tree.tokens, 0
                    for e in edits:
                        again += tree.edit(e["pos"] or 0, e["drop"] or 0, e["insert"] or "", encoder)
                    leaves = tree.leaves()
                    rows.append({"doc_id": r["doc_id"], "leaves": [t for t, _ in leaves], "tokens": [n for _, n in leaves],
                                 "n_edits": len(edits), "n_before": before, "n_after": tree.tokens, "n_reencoded": again})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    schema = pa.schema([("doc_id", pa.int64()), ("leaves", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32())),
                        *((c, pa.int64()) for c in ("n_edits", "n_before", "n_after", "n_reencoded"))])
    return trees.select("doc_id", "leaves", "tokens", "edits").mapInArrow(
        run, TREE_SCHEMA + ", n_edits bigint, n_before bigint, n_after bigint, n_reencoded bigint")


def own_edits() -> Column:
    """Three edits of a document drawn from its id and text: a passage of it is
    inserted elsewhere, up to 59 characters are deleted, and 12 are replaced by its source."""
    length = F.greatest(F.char_length(text_of()), F.lit(1))

    def place(turn: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(turn)), length)
    edits = [(place(1), F.lit(0), F.substr(text_of(), (place(2) + 1).cast("int"), F.lit(40))),
             (place(2), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(60)), F.lit("")),
             (place(3), F.lit(12), F.coalesce(F.col("source").cast("string"), F.lit("")))]
    return F.array(*[F.struct(p.cast("bigint").alias("pos"), d.cast("bigint").alias("drop"), i.alias("insert"))
                     for p, d, i in edits])


def edited_counts(docs: DataFrame, vocabulary: str, edits: Column) -> DataFrame:
    """One row per document row: doc_id, n_edits, n_before, n_after, n_reencoded.
    The trees are written first, as kept state; edits start from them.  Null and
    empty texts are one empty leaf, very long ones many leaves.  Rows that repeat an id are documents each;
    other columns are ignored; an empty table gives no rows."""
    trees = materialize(build_trees(docs, vocabulary, edits), "token-trees")
    return apply_edits(trees, vocabulary).drop("leaves", "tokens")
