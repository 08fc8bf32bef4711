"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaloom.llm import alignment as al
from alphaloom.llm import queries
from alphaloom.llm.tokens import vocabulary_path
from alphaloom.llm.two_tokens import pair_encoder
from tests.conftest import SF_CHECK

from .helpers import SCHEMA, awkward, awkward_rows, clashing, rows_of

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
TRICKY = ["a▁b", "<s> x </s><unk>", "<0x0A> <|endoftext|>", "\x00a\tb\r\n", "Ⅳ ﬁ é é́", "﻿x", "日本 語", "a　b   c", "x  ",
          "  ", "\n", "😀 😀", " lead", "a  b   c", "a\n b", "a\n  b", "x \n y", "tab\t x", "don't I'll", "1234 56 7,8", "\x1c x", "a\xa0 b", " "]


def plain_tokens():
    """Bytes of every id of both sides, read from the libraries anew."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, ByteLevel


def plain_alignment(text, a, b, vocabulary):
    """(groups, links) by walking over the bytes of the whole text."""
    if not text:
        return [], []
    spaced = " " + text
    a_ids, b_ids = a.encode(spaced, add_special_tokens=False).ids, b.encode(text)
    a_tokens = [vocabulary[i] for i in a_ids]
    b_tokens = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_tokens.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    if b"".join(a_tokens) != spaced.encode() or b"".join(b_tokens) != spaced.encode():
        return [], []
    owner_a = [k for k, t in enumerate(a_tokens) for _ in t]
    owner_b = [k for k, t in enumerate(b_tokens) for _ in t]
    links = sorted(set(zip(owner_a, owner_b)))
    ends_a, ends_b = set(np.cumsum([len(t) for t in a_tokens]).tolist()), set(np.cumsum([len(t) for t in b_tokens]).tolist())
    groups, start = [], 0
    for end in sorted(ends_a & ends_b):
        own_a, own_b = sorted(set(owner_a[start:end])), sorted(set(owner_b[start:end]))
        groups.append(",".join(str(a_ids[k]) for k in own_a) + "|" + ",".join(str(b_ids[k]) for k in own_b))
        start = end
    return groups, [(a_ids[x], b_ids[y]) for x, y in links]


@pytest.fixture(scope="module")
def sides():
    from tokenizers import Tokenizer
    a, b, _ = plain_tokens()
    alphabet, hidden = {}, 0
    for byte in range(256):                                     # the byte-level alphabet, by its rule
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(256 + hidden)] = byte
            hidden += 1
    special = {t.content for t in Tokenizer.from_file(A).get_added_tokens_decoder().values()}
    vocabulary = {i: t.encode() if t in special else bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items()}
    return a, b, vocabulary


def brute(rows, sides):
    found = [(r[0], *plain_alignment(r[1], *sides)) for r in rows]
    count = Counter(p for _, _, links in found for p in set(links))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for doc_id, groups, links in found:
        n_a = sum(g.split("|")[0].count(",") + 1 for g in groups)
        n_b = sum(g.split("|")[1].count(",") + 1 for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), count, highest


def chunked(texts):
    coder = pair_encoder(A, B)
    coded, offsets = coder.chunks(pa.array(texts, pa.string()))
    found = coder.lookup(coded.dictionary)
    index, out = coded.indices.to_pylist(), []
    for s, e in zip(offsets[:-1], offsets[1:]):
        own = index[s:e]
        if any(found.counts[i, 0] < 0 for i in own):
            out.append(([], []))
            continue
        links = [int(x) for i in own for x in found.links[found.starts[i]:found.starts[i + 1]]]
        out.append((b";".join(found.groups[i] for i in own).decode().split(";"),
                    [(x >> coder.b_bits, x & ((1 << coder.b_bits) - 1)) for x in links]))
    return out


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(alphabet="abé' \n\t\x1c　▁日1.,<|>", min_size=1, max_size=40),
                                st.text(min_size=1, max_size=25)), min_size=1, max_size=8))
def test_chunks_align_like_whole_texts(texts, sides):
    assert chunked(texts) == [plain_alignment(t, *sides) for t in texts]


def test_tricky_texts_align_like_whole_texts(sides):
    for group in (TRICKY, TRICKY[::-1], *([t] for t in TRICKY)):
        assert chunked(group) == [plain_alignment(t, *sides) for t in group]
    assert plain_alignment("a▁b", *sides) == ([], []) and plain_alignment("日本", *sides)[0]


def test_equal_to_the_plain_version(spark, sides, monkeypatch):
    rows = awkward_rows() + [(1000 + i, t, "en", "s", None) for i, t in enumerate(TRICKY * 2)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, count, highest = brute(rows, sides)
    assert rows_of(al.alignment_digests(docs, A, B), *COLUMNS, "groups_sha256") == want
    small = al.align(docs, A, B, run_bytes=500, with_groups=True)
    assert small.n_runs > 20
    monkeypatch.setattr(al, "FAN_IN", 3)                        # merges in levels, several tasks a radix partition
    levels = al.Alignment(small.runs, al.pair_totals(small.runs, small.n_runs, small.partitions, small.sides.b_bits),
                          small.n_runs, small.partitions, small.sides)
    for found in (small, levels):
        got = found.documents()
        assert rows_of(got, *COLUMNS) == sorted((w[:7] for w in want), key=repr)
        texts = {r.doc_id: bytes(r.groups).decode() for r in got.collect() if r.doc_id and r.doc_id >= 1000}
        assert texts == {r[0]: ";".join(plain_alignment(r[1], *sides)[0]) for r in rows if r[0] and r[0] >= 1000}
        pairs = {(r.a_id, r.b_id): (r.docs, r.best) for r in found.pairs().collect()}
        assert pairs == {p: (n, n == highest[p[0]]) for p, n in count.items()}


def test_empty_table_and_tables_without_tokens(spark):
    empty = clashing(spark.createDataFrame([], SCHEMA))
    assert al.alignment_digests(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "a▁b", "en", "s", 3)], SCHEMA)
    assert rows_of(al.alignment_digests(none, A, B), *COLUMNS, "groups_sha256") == sorted(
        [(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2, None)], key=repr)
    assert al.align(none, A, B).pairs().collect() == []


def test_query_over_the_documents(spark, sides):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    got = queries.op13_alignment(spark, SF_CHECK)
    assert rows_of(got, *COLUMNS, "groups_sha256") == brute(docs, sides)[0]


@pytest.mark.parametrize("seed", range(4))
def test_heap_merge_adds_up_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(al, "MERGE_BLOCK", 7)
    monkeypatch.setattr(al, "EMIT", 40)
    runs, want = [], Counter()
    for _ in range(rng.randrange(1, 20)):
        pairs = np.array(sorted(rng.sample(range(3000), rng.randrange(1, 300))), np.uint32)
        counts = np.array([rng.randrange(1, 9) for _ in pairs], np.uint32)
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append((int(pairs[0]), lambda p=pairs, c=counts: (p, c)))
    got, last = [], -1
    for pairs, n in al.heap_merge(runs, 5):
        assert int(pairs[0]) >> 5 > last                        # no group is cut
        last = int(pairs[-1]) >> 5
        got += zip(pairs.tolist(), n.tolist())
    assert got == sorted(want.items())


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        pairs = np.unique(rng.integers(0, 1 << 31, n)).astype(np.uint32)
        assert (al.unpacked_pairs(al.packed_pairs(pairs)) == pairs).all()
        wide = rng.integers(0, 1 << 60, n)
        assert (al.unpacked(al.packed(wide), "<i8") == wide).all()
    sides = al.Sides(pair_encoder(A, B))
    a, b = rng.integers(0, 50257, 500), rng.integers(0, 32000, 500)
    back = sides.ids(sides.keys(a << sides.b_bits | b))
    assert (back[0] == a).all() and (back[1] == b).all()
