import random
from collections import Counter

import numpy as np
import pytest

from alphaloom.llm import graph_ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """rows: {vec_id: vector}."""
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = [float(x[i] @ v) for v in x]
            out[q] = sorted(((-s[j], c) for j, c in enumerate(ids) if c != q))[:k]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q, best in want.items():
        mine = by.get(q, {})
        assert sorted(mine) == list(range(1, len(best) + 1))
        hit += len({v for v, _ in mine.values()} & {v for _, v in best})
        total += len(best)
        order = [(-mine[r][1], mine[r][0]) for r in sorted(mine)]
        assert order == sorted(order) and q not in {v for v, _ in mine.values()}
    assert set(by) == set(want)
    return hit / max(total, 1)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    got = graph_ann.nearest(table).collect()
    rows = {r.vec_id: r.embedding for r in table.collect()}
    assert recall(got, brute(rows)) >= 0.95
    for r in random.Random(1).sample(got, 50):
        exact = np.array(rows[r.query_id], np.float32).astype(float) @ np.array(rows[r.vec_id], np.float32).astype(float)
        assert abs(exact - r.score) < 1e-12


def test_recall_over_many_shards_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(graph_ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2500, 12)) * rng.lognormal(0, 0.5, size=(2500, 1))
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    got = graph_ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA)).collect()
    assert recall(got, brute(rows)) >= 0.95


@pytest.mark.parametrize("longest", [1e4, 1e30])
def test_recall_beside_a_few_very_long_vectors(spark, longest):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[[7, 100, 1501]] *= [[longest], [longest / 3], [1e-3 / longest]]
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    got = graph_ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA)).collect()
    assert recall(got, brute(rows)) >= 0.95
    assert all(np.isfinite(r.score) for r in got)


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=8).astype(np.float32).tolist()
    rows = {i: common for i in range(0, 400)}
    rows |= {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(400, 900)}
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [float("inf")] + [1.0] * 7),
           (1080, [None] + [1.0] * 7), (1100, [1.0] * 5), (None, [1.0] * 8), (1120, [])]
    data = [(i, v, 0) for i, v in rows.items()] + [(i, v, None) for i, v in bad]
    got = [r for r in graph_ann.nearest(spark.createDataFrame(data, SCHEMA).withColumnRenamed("label", "vec")).collect()
           if r.query_id != 1100]
    want = brute(rows)
    assert recall(got, want) >= 0.97
    top = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 0)
    assert [v for _, v in top] == [v for _, v in want[0]] == list(range(1, 21))


def brute_rows(rows, every=20, k=20):
    """rows: (vec_id, vector) list, ids may repeat: results of every query row among all other rows of its length."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % every == 0:
            found = sorted((-float(np.dot(x, y)), v) for j, (v, y) in enumerate(rows) if j != i and len(y) == len(x))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(found)]
    return sorted(out)


def test_two_lengths_repeated_ids_and_doubles(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8)) for i in range(150)] + [(i, rng.normal(size=5)) for i in range(100, 160)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, rng.normal(size=8)), (60, rows[3][1]), (3, rows[3][1]), (0, rng.normal(size=1))]
    data = [(i, x.tolist(), 0) for i, x in rows]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in graph_ann.nearest(df).collect())
    want = brute_rows(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    same = sum(Counter((q, v) for q, _, v, _ in got)[p] >= n for p, n in Counter((q, v) for q, _, v, _ in want).items())
    assert same >= 0.95 * len(Counter((q, v) for q, _, v, _ in want))
    by = {}
    for i, x in rows:
        by.setdefault(i, []).append(x)
    for q, _, v, score in got:                      # exactly the product of two given rows, in doubles
        assert any(len(a) == len(b) and abs(float(np.dot(a, b)) - score) < 1e-14 for a in by[q] for b in by[v])
    assert sum(q == 20 and n == 1 for q, n, _, _ in got) == 3 and {v for q, n, v, _ in got if q == 20} >= {20}


def test_recall_over_shards_of_real_size(spark):
    """A shard beyond 20,000 nodes, as the production settings make it."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 24_000)] + 0.4 * rng.normal(size=(24_000, 32))).astype(np.float32)
    x[12_000:] *= 40.0                              # two bands of lengths, so two shards
    rows = dict(enumerate(x.tolist()))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA)
    got = graph_ann.nearest(df, every=400).collect()
    want = {}
    for q in range(0, 24_000, 400):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        want[q] = [(-score[j], int(j)) for j in best]
    assert recall(got, want) >= 0.95


def test_few_and_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (20, [0.0, 2.0], 1)], SCHEMA)
    got = graph_ann.nearest(few).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [
        (0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert graph_ann.nearest(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).collect() == []
    assert graph_ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert graph_ann.nearest(spark.createDataFrame([(0, [0.0], 1)], SCHEMA)).collect() == []


def test_pruning_keeps_diverse_edges():
    points = graph_ann.lifted(np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-1, 0]], np.float32))
    kept = graph_ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]]), 4, 1.2)
    assert set(kept[0]) >= {1, 3, 4} - {-1} and 2 not in kept[0]
