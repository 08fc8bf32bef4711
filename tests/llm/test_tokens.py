import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaloom.llm import mixing, packing, token_binary
from alphaloom.llm.tokens import encoder, vocabulary_path
from tests.conftest import SF_CHECK

from .helpers import SCHEMA, WORD, awkward, awkward_rows, clashing

BYTE, WORDS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORDS])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(
    st.text(alphabet="ab' \n\t\x01é́.1日<|> ", max_size=30), st.text(max_size=20)), max_size=12))
def test_pieces_encode_like_the_whole_text(path, texts):
    coder = encoder(path)
    got = []
    for _, ids, counts in coder.encode(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x.tolist() for x in coder.whole(texts)]


def library_ids(path, text):
    """The contract's call on a tokenizer of its own."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


SPECIAL = ["one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>b c", "x <|endoftext|>", "<|endoftext|><|startoftext|> y z",
           "plain words here", "<|EndOfText|> in capitals", "<|endof text|>", "a  <|endoftext|>\n", "endoftext <| |>", ""]


def test_special_token_strings_give_the_library_s_ids(spark):
    for path in (BYTE, WORDS):
        got = []
        for _, ids, counts in encoder(path).encode(pa.array(SPECIAL, pa.string())):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library_ids(path, t) for t in SPECIAL]
    assert library_ids(BYTE, SPECIAL[0]) == [505, 220, 50256, 734]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(SPECIAL)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = [np.r_[library_ids(BYTE, t), 2].astype("<u4") for t in SPECIAL]
    tokens = sorted(token_binary.round_trip(docs, BYTE).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in tokens] == [(len(i), zlib.crc32(i)) for i in want]
    assert [r.start for r in tokens] == np.r_[0, np.cumsum([len(i) for i in want])][:-1].tolist()
    want = [np.r_[library_ids(WORDS, t), 1].astype("<u4") for t in SPECIAL]
    pieces = packing.pack(docs, WORDS).collect()
    covered = Counter()
    for r in pieces:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length])
        covered[r.doc_id] += r.length
    assert covered == {i: len(ids) for i, ids in enumerate(want)}


def plain_ids(path, text, end):
    return np.r_[encoder(path).whole([text or ""])[0], end].astype("<u4")


def check_tokens(rows, got):
    got = sorted(got, key=lambda r: r.start)
    want = [(d, plain_ids(BYTE, t, 2)) for d, t, *_ in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), zlib.crc32(i)) for d, i in want)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()


def test_token_files_round_trip(spark):
    check_tokens(awkward_rows(), token_binary.round_trip(clashing(awkward(spark)), BYTE).collect())
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    check_tokens([(r.doc_id, r.text) for r in docs.collect()], token_binary.round_trip(docs, BYTE).collect())
    assert token_binary.round_trip(spark.createDataFrame([], SCHEMA), BYTE).collect() == []


def brute_length_cost(counts, limit):
    """Cheapest total bits by dynamic programming over sorted counts and Kraft sums."""
    order = sorted(counts, reverse=True)
    best = {(1 << limit): 0}
    for i, c in enumerate(order):
        nxt = {}
        for room, cost in best.items():
            for length in range(1, limit + 1):
                left = room - (1 << (limit - length))
                if left >= 0 and cost + c * length < nxt.get(left, 1 << 60):
                    nxt[left] = cost + c * length
        best = nxt
    return min(best.values())


@pytest.mark.parametrize("seed", range(8))
def test_code_lengths_are_optimal_and_prefix_free(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 9)
    counts = np.array([rng.choice([1, 1, 3, 50, 4000]) for _ in range(n)])
    limit = 4
    lengths = token_binary.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -lengths.astype(float)) <= 1
    assert int((lengths.astype(int) * counts).sum()) == brute_length_cost(counts.tolist(), limit)


def test_block_codec_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 40000).astype(np.int32)
        lengths = token_binary.code_lengths(np.bincount(ids))
        payload, marks = token_binary.encode_block(ids, lengths, token_binary.canonical_codes(lengths))
        back = token_binary.decode_block(payload, marks, n, *token_binary.decode_tables(lengths))
        assert (back == ids).all()


def check_packing(rows, got, window=2048):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(plain_ids(WORDS, t, 1))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        covered = Counter()
        for p in pieces:
            fits = [i for i in want[d] if len(i) == p.doc_tokens and zlib.crc32(i[p.start:p.start + p.length]) == p.ids_crc32]
            assert fits and p.length > 0
            covered[p.doc_tokens] += p.length
        assert covered == Counter({n: n * k for n, k in Counter(len(i) for i in want[d]).items()})
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0      # nothing to pad
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_covers_every_id_once(spark):
    check_packing(awkward_rows(), packing.pack(clashing(awkward(spark)), WORDS).collect())
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, WORDS, with_ids=False).collect())
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


def test_packing_solves_an_exact_histogram():
    h = np.zeros(2048, np.int64)
    h[[1000, 1048]] = 500
    h[[512, 1024]] = 600, 300
    rows = packing.combinations(h, 2048)
    copies = packing.solve_repeats(h, rows, 2048)
    assert (packing.use_counts(rows, copies, 2048) == h).all()


def test_stream_tail_needs_no_padding():
    for total in (1, 2047, 2048, 5000, 4095):
        at, parts = 0, defaultdict(int)
        for n in [700, 1, 900] * 20:
            n = min(n, total - at)
            if n:
                for length, sequence, offset in packing.stream_pieces(at, n, total, 5, 2048):
                    assert offset == parts[sequence]
                    parts[sequence] += length
                at += n
        if at < total:
            for length, sequence, offset in packing.stream_pieces(at, total - at, total, 5, 2048):
                parts[sequence] += length
        assert sum(parts.values()) == total and all(v & (v - 1) == 0 for v in parts.values())


def brute_mix(rows, block=mixing.BLOCK_WORDS):
    sizes = defaultdict(int)
    for d, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, weights, capped = sum(sizes.values()), {s: 1 + i % 3 for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return sizes, capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def check_mix(rows, got):
    sizes, targets = brute_mix(rows)
    taken = defaultdict(int)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, _, s, *_ in rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    return targets


@pytest.mark.parametrize("block", [7, 256])
def test_mix_hits_every_target(spark, block):
    rows = awkward_rows()
    first = mixing.mix(clashing(awkward(spark)).drop("size", "taken"), block).collect()
    check_mix(rows, first)
    again = mixing.mix(awkward(spark).repartition(5), block).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    check_mix([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], mixing.mix(docs, block).collect())


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a", None), (2, " ", None, None, None)], SCHEMA)
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}
    assert mixing.mixed_documents(blank).collect() == []


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] >= 100]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, 16).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs, 16).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert got == {d: n for d, n in taken.items() if n}


def test_mixed_documents_of_null_and_repeated_ids_hit_every_target(spark):
    rng = random.Random(8)
    def prose(n):
        return " ".join(rng.choices([f"w{i}" for i in range(900)], k=n))
    rows = [(None, prose(10), "en", "a", 0) for _ in range(30)] + [(i % 4, prose(7), "en", "b", 0) for i in range(40)]
    rows += [(50 + i, prose(90), "de", "c", 0) for i in range(20)] + [(5, rows[0][1], "en", "b", 0)] * 6
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mixed_documents(docs, 16).collect()
    _, targets = brute_mix(rows)
    words = Counter()
    for r in got:
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - t) <= 1 for s, t in targets.items()), (words, targets)
    def taken(s, d):
        return sorted(r.taken for r in mixing.mix(docs, 16).collect() if r.source == s and r.doc_id == d)
    by_text = Counter()
    for r in got:
        if r.doc_id is None:
            by_text[next(t for _, t, *_ in rows[:30] if t.startswith(r.text))] += len(WORD.findall(r.text))
    assert sorted(by_text.values()) == [n for n in taken("a", None) if n]
    assert sum(len(WORD.findall(r.text)) for r in got if r.doc_id == 5) == sum(taken("b", 5))


def test_schedule_spreads_sources_evenly(spark):
    plan = [{"source": s, "no": i, "source_size": 100000, "target": t, "words": t, "blocks": 1000, "slots": t // 100}
            for i, (s, t) in enumerate([("a", 10000), ("b", 20000), ("c", 30000)])]
    slots = sorted(mixing.schedule(spark, plan, 100).collect())
    assert sum(r.words for r in slots) == 60000
    for stretch in range(0, 600, 60):
        seen = Counter(r.source_no for r in slots if stretch <= r.slot < stretch + 60)
        assert all(abs(seen[i] - n) <= 3 for i, n in enumerate((10, 20, 30)))
    for i in range(3):
        ranks = [r.epoch * 1000 + r.block for r in slots if r.source_no == i]
        assert ranks == list(range(len(ranks)))
