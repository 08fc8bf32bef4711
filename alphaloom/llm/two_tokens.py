"""One text under two tokenizers, word by word, and the token pairs that overlap.

Side A is a byte-level BPE, side B a sentencepiece BPE with byte fallback; both see
the text after one space.  Where a space follows a character that is no white space, a token
of either side ends, whatever stands around (A's pre-tokens start there; no piece of B
has a space inside), so a text is a run of chunks and each distinct chunk needs to be
encoded, cut into groups and linked once.  A worker keeps a bounded number of chunks.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

CACHE_CHUNKS = 300_000          # chunks kept per worker process (about 60 MB)
JOINED = 400                    # chunks encoded by one call
CUT = re.compile(r"(?<=\S)(?= )")
ODD = r"(?:^|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) | $"


def _byte_level() -> dict[str, int]:
    """Byte of every character of the byte-level alphabet: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def side_a_tokens(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    alphabet = _byte_level()
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def side_b_tokens(model) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligned:
    """Chunks in CSR form: links, and per chunk token counts, groups and their text."""

    def __init__(self, links, starts, counts, groups):
        self.links, self.starts, self.counts, self.groups = links, starts, counts, groups


class PairEncoder:
    """Two tokenizers and the cache of aligned chunks."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = side_a_tokens(self.a), side_b_tokens(self.b)
        if any(b" " in t.lstrip(b" ") for t in self.b_bytes):
            raise ValueError(f"{b_path}: a piece has a space inside, so texts can't be cut at spaces")
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.b_space = self.b.piece_to_id("▁")
        self.b_bits = max(1, int(len(self.b_bytes) - 1).bit_length())
        self.known = pa.array([], pa.string())
        self.kept = Aligned(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros((0, 3), np.int32), [])
        if int(len(self.a_bytes) - 1).bit_length() + self.b_bits > 32:
            raise ValueError("a pair of ids must fit in 32 bits")

    def ids(self, spaced: str) -> tuple[list[int], list[int]]:
        """Ids of both sides for a text that starts with the added space."""
        b = self.b.encode(spaced[1:]) if len(spaced) > 1 else [self.b_space]
        return self.a.encode(spaced, add_special_tokens=False).ids, b

    def _exact(self, ids: list[int], tokens: list[bytes], data: bytes) -> bool:
        return b"".join([tokens[i] for i in ids]) == data

    def _align(self, chunks: list[str]) -> Aligned:
        """Chunks (each starts with a space), some hundred at a time as one text;
        where the bytes of a side differ from it, chunk by chunk.  A chunk whose own bytes differ has -1 tokens."""
        a_parts, b_parts, a_n, b_n, bad = [], [], [], [], []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at:at + JOINED]
            text = "".join(part)
            data = text.encode()
            apart = len(part) > 1 and any(c[-1].isspace() for c in part)    # white space may join the next chunk's
            a, b = ([], []) if apart else self.ids(text)
            if not (self._exact(a, self.a_bytes, data) and self._exact(b, self.b_bytes, data)):
                if len(part) > 1:
                    for chunk in part:
                        own_a, own_b = self.ids(chunk)
                        raw = chunk.encode()
                        ok = self._exact(own_a, self.a_bytes, raw) and self._exact(own_b, self.b_bytes, raw)
                        bad.append(not ok)
                        a_parts.append(np.array(own_a if ok else [], np.int64))
                        b_parts.append(np.array(own_b if ok else [], np.int64))
                        a_n.append(np.array([len(a_parts[-1])]))
                        b_n.append(np.array([len(b_parts[-1])]))
                    continue
                bad.append(True)
                a, b = [], []
            else:
                bad += [False] * len(part)
            ends = np.cumsum([len(c.encode()) for c in part])
            for ids, lengths, parts, counts in ((a, self.a_len, a_parts, a_n), (b, self.b_len, b_parts, b_n)):
                ids = np.array(ids, np.int64)
                upto = np.searchsorted(np.cumsum(lengths[ids]), ends, side="right")
                parts.append(ids)
                counts.append(np.diff(upto, prepend=0))
        flat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        return self._linked(flat(a_parts), flat(a_n), flat(b_parts), flat(b_n), np.array(bad, bool))

    def _linked(self, a, a_n, b, b_n, bad) -> Aligned:
        """Groups and links of chunks laid end to end: all tokens as byte ranges on one line."""
        m = len(a_n)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        a_chunk, b_chunk = np.repeat(np.arange(m), a_n), np.repeat(np.arange(m), b_n)
        # a link for each stretch between two neighbouring ends of either side
        cuts = np.union1d(a_end, b_end)
        ia, ib = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        links = ((a[ia] << self.b_bits) | b[ib]).astype(np.uint32)
        per = np.bincount(a_chunk[ia], minlength=m) if len(cuts) else np.zeros(m, np.int64)
        a_ends = np.searchsorted(a_group, np.arange(len(both)), side="right").tolist()
        b_ends = np.searchsorted(b_group, np.arange(len(both)), side="right").tolist()
        a_str, b_str = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, i, j = [], 0, 0
        for k, e in zip(a_ends, b_ends):
            texts.append(a_str[i] + "|" + b_str[j] if k == i + 1 and e == j + 1
                         else ",".join(a_str[i:k]) + "|" + ",".join(b_str[j:e]))
            i, j = k, e
        chunk_of = a_chunk[np.searchsorted(a_end, both)] if len(both) else np.zeros(0, np.int64)
        n_groups = np.bincount(chunk_of, minlength=m)
        ends = np.cumsum(n_groups).tolist()
        groups = [";".join(texts[s:e]).encode() for s, e in zip([0, *ends], ends)]
        counts = np.stack([np.where(bad, -1, a_n), b_n, n_groups], axis=1).astype(np.int32)
        return Aligned(links, np.r_[0, np.cumsum(per)], counts, groups)

    def lookup(self, uniques: pa.Array) -> Aligned:
        """The aligned chunks of ``uniques``, one entry for each, the new ones encoded."""
        at = pc.index_in(uniques, value_set=self.known)
        missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        open_end = pc.utf8_is_space(pc.utf8_slice_codeunits(uniques.take(pa.array(missing)), -1)).to_numpy(zero_copy_only=False)
        missing = np.r_[missing[~open_end], missing[open_end]]
        names = uniques.take(pa.array(missing))
        new, old = self._align(names.to_pylist()), self.kept
        shift = len(self.known)
        at[missing] = shift + np.arange(len(missing))
        starts = np.r_[old.starts, old.starts[-1] + new.starts[1:]]
        links = np.concatenate([old.links, new.links])
        counts = np.concatenate([old.counts, new.counts])
        groups = old.groups + new.groups
        size = np.diff(starts)[at]
        ends = np.cumsum(size)
        spread = np.repeat(starts[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = Aligned(links[spread], np.r_[0, ends], counts[at], [groups[i] for i in at.tolist()])
        room = min(CACHE_CHUNKS - shift, len(missing))
        if room > 0:
            n = shift + room
            self.known = pa.concat_arrays([self.known, names[:room].cast(pa.string())])
            self.kept = Aligned(links[:starts[n]], starts[:n + 1], counts[:n], groups[:n])
        return out

    def chunks(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of non-empty texts (numbered), and the offsets of the texts in them."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        if not odd.any():
            offsets = split.offsets.to_numpy().astype(np.int64)
            words = split.flatten()
            return pc.binary_join_element_wise("", words, " ").dictionary_encode(), offsets - offsets[0]
        lists = split.to_pylist()
        for i in np.flatnonzero(odd).tolist():
            lists[i] = [c[1:] for c in CUT.split(" " + texts[i].as_py())]
        offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
        flat = pa.array([" " + w for x in lists for w in x], pa.string())
        return flat.dictionary_encode(), offsets


def pair_encoder(a_path: str, b_path: str) -> PairEncoder:
    """The worker process's encoder for two vocabulary files."""
    cache = worker_cache()
    if ("pair", a_path, b_path) not in cache:
        cache["pair", a_path, b_path] = PairEncoder(a_path, b_path)
    return cache["pair", a_path, b_path]
