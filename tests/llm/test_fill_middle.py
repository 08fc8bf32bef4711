"""Fill-in-middle against a plain version, and the index against Python's strings."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaloom.llm import fill_middle as fm
from alphaloom.llm import queries
from tests.conftest import SF_SMALL

from .helpers import SCHEMA, awkward, awkward_rows, clashing, rows_of

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
TRICKY = ["<", "S>", "a<", "é\n日本\n😀x\n", "\n\n\n", "\n", "x<P>y\nz", "<S", "a\r\nb c\nd", "é" * 50, "<M>", "<<<\n>>>\n<S\nP>"]


def brute(doc_id, text, unit="line", fim=100, spm=50, seed=7):
    t = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    n = len(parts)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, t
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé日😀\n")), max_size=60))
def test_index_converts_both_ways(text):
    index = fm.MultibyteIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:i].encode()) for i in chars])
    assert index.bytes(chars).tolist() == cuts.tolist()
    assert index.chars(cuts).tolist() == chars.tolist()
    assert len(index.at) == sum(ord(c) > 127 for c in text)


def test_ascii_texts_leave_no_entry():
    assert len(fm.MultibyteIndex(np.frombuffer(b"plain\ntext", np.uint8)).at) == 0


@pytest.mark.parametrize("unit", ["line", "char"])
def test_equal_to_the_plain_version(spark, unit):
    rows = awkward_rows() + [(1000 + i, t * (1 + i % 3), "en", "s", None) for i, t in enumerate(TRICKY * 6)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = fm.fill_in_middle(docs, unit=unit, fim_percent=80, spm_percent=30, seed=11)
    assert rows_of(got, *COLUMNS) == sorted((brute(r[0], r[1], unit, 80, 30, 11) for r in rows), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fm.restored_text().alias("t"))
    assert rows_of(back, "doc_id", "t") == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_several_chunks_of_a_batch_and_one_long_text(spark):
    long = "é line of words\n" * 200_000
    texts = {1: long, 2: "a\nb", 3: "", 4: "日\n本"}
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in texts.items()], SCHEMA).coalesce(1)
    for size in (3, 1 << 20):
        got = fm.fill_in_middle(docs, chunk_bytes=size)
        assert rows_of(got, *COLUMNS) == sorted((brute(k, t) for k, t in texts.items()), key=repr)


def test_digests_and_empty_table(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*r[:5], sha(r[5]), sha(d[1] or "")) for d in awkward_rows() for r in [brute(d[0], d[1])]]
    got = fm.cut_digests(awkward(spark))
    assert rows_of(got, *COLUMNS[:5], "output_sha256", "restored_sha256") == sorted(want, key=repr)
    assert fm.cut_digests(clashing(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_restores_every_document(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    got = queries.op12_fill_middle(spark, SF_SMALL)
    assert rows_of(got, "doc_id", "restored_sha256") == sorted(want, key=repr)
