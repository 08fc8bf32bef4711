"""Encoding batches of texts with the ``tokenizers`` library, piece by piece.

Both vocabularies never merge across a single space between two characters that are
not white space, so a text can be split there and each distinct piece of a
batch encoded once.  Arrow splits and numbers the pieces; only pieces that are
new to the worker's bounded cache go through the library.  Texts in which
white space stands at an edge or beside other white space, and texts that hold an
added token's string (the library makes it that token), are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

CACHE_PIECES = 800_000          # pieces kept per worker process (about 35 MB of Arrow and numpy arrays)
CHUNK_BYTES = 16 << 20          # text whose pieces are numbered at once
PIECES_AT_ONCE = 500_000        # pieces whose ids are laid out at once
GROUP = 1000                    # pieces joined into one call of the library
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = f"(?:{_WS}{{2}})|(?:^{_WS})|(?:{_WS}$)"
MARK = "\x01"                   # stands between joined pieces where spaces leave no trace in the ids


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceEncoder:
    """One tokenizer with its cache of encoded pieces (CSR arrays)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: added tokens are looked for in normalized text")
        self.unsafe = "|".join([UNSAFE, *map(re.escape, added)])
        bare, spaced = self.whole(["a", " a"])
        self.spaced = list(bare) != list(spaced)        # a space before a piece belongs to it
        if self.spaced:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            lead = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t.startswith(lead)]] = True
        else:
            mark = self.whole([MARK])[0]
            if len(mark) != 1:
                raise ValueError(f"{path}: the mark is not one token")
            self.mark = int(mark[0])
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in got]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (each after a space), end to end, and their lengths."""
        lead, joint = (" ", " ") if self.spaced else ("", f" {MARK} ")
        ids, lengths = [], []
        groups = [pieces[i:i + GROUP] for i in range(0, len(pieces), GROUP)]
        for g, t in zip(groups, self.whole([lead + joint.join(g) for g in groups])):
            cuts = np.flatnonzero(self.opens[t]) if self.spaced else np.r_[-1, np.flatnonzero(t == self.mark)]
            if len(cuts) != len(g) or "" in g or (not self.spaced and MARK in "".join(g)):
                alone = self.whole([lead + p for p in g])       # the boundaries are ambiguous
                ids += alone
                lengths += map(len, alone)
            elif self.spaced:
                ids.append(t)
                lengths += np.diff(cuts, append=len(t)).tolist()
            else:
                ids.append(t[t != self.mark])
                lengths += (np.diff(cuts, append=len(t)) - 1).tolist()
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.array(lengths, np.int64)

    def _lookup(self, uniques: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, lengths) with one entry per unique piece."""
        at = pc.index_in(uniques, value_set=self.known)
        missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = uniques.take(pa.array(missing))
        ids, lengths = self._pieces(new.to_pylist())
        new_starts = np.r_[0, np.cumsum(lengths)]
        flat = np.concatenate([self.flat, ids])
        starts = np.empty(len(at), np.int64)
        sizes = np.empty(len(at), np.int64)
        if len(self.known):
            starts[:], sizes[:] = self.starts[at], self.starts[at + 1] - self.starts[at]
        starts[missing], sizes[missing] = new_starts[:-1] + len(self.flat), lengths
        room = max(0, CACHE_PIECES - len(self.known))
        if room and len(new):
            kept = new[:room]
            self.known = pa.concat_arrays([self.known, kept.cast(pa.string())])
            self.flat = flat[:len(self.flat) + new_starts[len(kept)]]
            self.starts = np.r_[self.starts, self.starts[-1] + new_starts[1:len(kept) + 1]]
        return flat, starts, sizes

    def _chunk(self, texts: pa.Array):
        """(first row, ids, counts) for runs of rows; distinct pieces of all the
        texts are looked up at once, ids are laid out for PIECES_AT_ONCE at a time."""
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        n = len(texts)
        safe = np.flatnonzero(~unsafe)
        split = pc.split_pattern(texts.take(pa.array(safe)) if unsafe.any() else texts, " ")
        offsets = split.offsets.to_numpy()
        pieces = split.flatten()
        offsets = offsets - offsets[0]
        firsts = pieces.take(pa.array(offsets[:-1])).to_pylist() if self.spaced else None
        coded = pieces.dictionary_encode()
        del split, pieces
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes = self._lookup(coded.dictionary)
        if self.spaced:                         # a text's first piece has no space before it
            firsts = self.whole(firsts)
            lengths = np.fromiter(map(len, firsts), np.int64, len(firsts))
            index = index.copy()
            index[offsets[:-1]] = len(starts) + np.arange(len(firsts))
            starts = np.r_[starts, len(flat) + np.r_[0, np.cumsum(lengths)][:-1]]
            sizes = np.r_[sizes, lengths]
            flat = np.concatenate([flat, *firsts])
        ends = np.r_[0, np.cumsum(np.where(unsafe, 0, np.diff(offsets)[np.cumsum(~unsafe) - 1] if len(safe) else 0))]
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECES_AT_ONCE, side="right")) - 1)
            s, e = np.searchsorted(safe, (at, stop))
            part = index[offsets[s]:offsets[e]]
            span = sizes[part]
            out_ends = np.cumsum(span)
            total = int(out_ends[-1]) if len(out_ends) else 0
            shift = (starts[part] - out_ends + span).astype(np.int32)
            ids = flat[np.repeat(shift, span) + np.arange(total, dtype=np.int32)]
            bounds = np.r_[0, out_ends][offsets[s:e + 1] - offsets[s]]
            counts = np.zeros(stop - at, np.int64)
            counts[safe[s:e] - at] = np.diff(bounds)
            odd = np.flatnonzero(unsafe[at:stop])
            if len(odd):
                whole = self.whole(texts.take(pa.array(at + odd)).to_pylist())
                parts: list = [None] * (stop - at)
                for i, p in zip(odd, whole):
                    parts[i] = p
                for k, i in enumerate(safe[s:e] - at):
                    parts[i] = ids[bounds[k]:bounds[k + 1]]
                counts[odd] = [len(p) for p in whole]
                ids = np.concatenate(parts)
            yield at, ids, counts
            at = stop

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, counts) for runs of rows of bounded text size."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(texts):
            limit = (ends[at - 1] if at else 0) + CHUNK_BYTES
            stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            for row, ids, counts in self._chunk(texts.slice(at, stop - at)):
                yield at + row, ids, counts
            at = stop


def encoder(path: str) -> PieceEncoder:
    """The worker process's encoder for a vocabulary file."""
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceEncoder(path)
    return cache["pieces", path]


def id_type(path: str) -> str:
    """Little-endian storage of ids: two bytes if the vocabulary allows it."""
    return "<u2" if encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose i-th entry holds the bytes of the i-th run of ``values``."""
    offsets = np.r_[0, np.cumsum(counts)] * values.itemsize
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [
            None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    data = values.tobytes()
    return pa.array([data[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ids with ``end_id`` appended."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), counts + 1
