import random
from collections import defaultdict

import numpy as np
import pytest

from alphaloom.llm import components as cc
from alphaloom.llm import exact_mph, simhash
from tests.conftest import SF_SMALL

from .helpers import SCHEMA, awkward, awkward_rows, clashing, py_components, py_sha, py_simhash, rows_of


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out, seen = [], set()
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        first = (r[0], r[1] or "") not in seen
        seen.add((r[0], r[1] or ""))
        out.append((r[0], keep, len(ids), r[0] == keep and first, py_sha(r[1])))
    return sorted(out, key=repr)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_matches_brute_force(spark):
    assert rows_of(exact_mph.exact_dedup(awkward(spark)), *EXACT) == brute_exact(awkward_rows())
    assert rows_of(exact_mph.exact_dedup(clashing(awkward(spark))), *EXACT) == brute_exact(awkward_rows())


def test_exact_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_mph.exact_dedup(empty).collect() == []
    assert exact_mph.distinct_documents(empty).collect() == []


def test_distinct_documents_keep_one_row_per_text(spark):
    got = exact_mph.distinct_documents(clashing(awkward(spark)))
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in awkward_rows()})
    assert "clash" in {r.digest for r in got.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_perfect_hash_is_minimal_and_exact(n):
    import xxhash
    keys = [random.Random(i).randbytes(32) for i in range(n)]
    buckets = max(1, n // 4)
    slots, pilots = exact_mph.place_keys(keys, buckets)
    assert sorted(slots) == list(range(n))
    for k, s in zip(keys, slots):
        p = pilots[int.from_bytes(k[4:8], "big") % buckets]
        if p >= 0:
            h = xxhash.xxh64_intdigest(p.to_bytes(4, "little"), xxhash.xxh64_intdigest(k, 42))
            got = (h - (1 << 64) if h >> 63 else h) % n
        else:
            got = -p - 1
        assert got == s


def test_lookup_rejects_strangers_and_finds_members(spark):
    from pyspark.sql import functions as F
    def groups(a, b):
        return spark.range(a, b).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"),
                                        F.col("id").alias("winner"), F.lit(1).cast("bigint").alias("members"))
    index = exact_mph.build_index(groups(0, 40000), 40000)
    assert index.shards > 1
    found = exact_mph.lookup(groups(20000, 60000), index)
    assert found.count() == 40000
    assert {r[0] for r in found.where("pos is not null").agg({"new_winner": "max"}).collect()} == {39999}
    assert found.where("pos is not null").count() == 20000


def brute_simhash(rows):
    fps = [py_simhash(r[1]) for r in rows]
    roots = py_components(fps)
    low = {}
    for r, f in zip(rows, fps):
        k = roots[f]
        if r[0] is not None:
            low[k] = min(low.get(k, r[0]), r[0])
    return sorted([(r[0], f"{f:016x}", low.get(roots[f])) for r, f in zip(rows, fps)], key=repr)


def named(df):
    return df.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def test_simhash_matches_brute_force(spark):
    rows = awkward_rows()
    expected = brute_simhash(rows)
    cols = ("doc_id", "fingerprint", "component_id")
    assert rows_of(named(simhash.simhash_components(awkward(spark))), *cols) == expected
    assert rows_of(named(simhash.simhash_components(clashing(awkward(spark)))), *cols) == expected
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    expected = brute_simhash([tuple(r) for r in docs.collect()])
    assert rows_of(named(simhash.simhash_components(docs)), *cols) == expected


def test_simhash_empty_table_and_one_of_each(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
    kept = simhash.one_of_each(clashing(awkward(spark))).collect()
    groups = {c for _, _, c in brute_simhash(awkward_rows())}
    assert sorted((r.doc_id for r in kept), key=repr) == sorted(groups, key=repr)


def test_one_of_each_keeps_every_component_of_null_and_repeated_ids(spark):
    def prose(i):
        return " ".join(random.Random(i).choices([f"w{n}" for n in range(5000)], k=40))
    rows = [(None, prose(i)) for i in range(40)] + [(i % 5, prose(100 + i)) for i in range(40)]
    rows += [(2, prose(200)), (9, prose(200).upper()), (None, prose(200)), (9, prose(201)), (None, prose(300)), (None, prose(300))]
    rows = [(d, t, "en", "s", len(t)) for d, t in rows]
    roots = py_components(py_simhash(t) for _, t, *_ in rows)
    best = {}
    for d, t, *_ in rows:
        order = (d is None, d or 0, py_sha(t), t)
        best[roots[py_simhash(t)]] = min(order, best.get(roots[py_simhash(t)], order))
    want = sorted((None if none else d, t) for none, d, _, t in best.values() if not none) + \
        sorted((None, t) for none, _, _, t in best.values() if none)
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(want) == 83
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("list_rows", [8, 1024])
def test_near_links_lose_no_connection(spark, list_rows, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(12):             # chains of near fingerprints
            fps.add(f)
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) for b in range(64)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in cc.components(simhash.near_links(frame)).collect()}
    want = py_components(fps)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for f in fps:
        by_got[got.get(f, f)].add(f)
        by_want[want[f]].add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_components_of_path_star_and_isolated_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = cc.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    roots = defaultdict(set)
    for r in got.collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [200, 301]


def test_every_passing_pair_shares_a_list():
    keys = simhash.posting_keys(3)
    rng = np.random.default_rng(1)
    for _ in range(300):
        shared = set(rng.permutation(8)[:5].tolist())
        assert any(set(k) <= shared for k in keys)
