import math
import string
import struct
import zlib

import numpy as np
import xxhash

from alphaloom.llm import quality
from alphaloom.llm.common import table
from tests.conftest import SF_CHECK

from .helpers import SCHEMA, awkward, clashing

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    got = quality.score_documents(docs, labels)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert right >= 0.95, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()


def test_quality_never_reads_held_out_labels(spark):
    from pyspark.sql import functions as F
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    flipped = labels.withColumn("quality", F.when(quality.learn_rows(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-9)


def test_quality_edge_tables(spark):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 180)] + [(None, 1, 0), (101, None, None)], LABELS)
    for labels in (none, some):
        rows = quality.score_documents(clashing(awkward(spark)), labels).collect()
        assert len(rows) == awkward(spark).count()
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in quality.score_documents(awkward(spark), none).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score_documents(empty, some).collect() == []
    assert quality.keep_good(empty, none).collect() == []


def test_discriminant_matches_direct_log_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    xs = [rng.normal(size=(400, d)), rng.normal(1, 2, size=(300, d))]
    sums = [quality.ClassSums(len(x), x.sum(0), x.T @ x) for x in xs]
    m = quality.fit(sums, 0.3, 0.1, 1.0)
    z = (xs[1][:20] - m.centre) / m.scale
    want = []
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        diff = z - m.means[k]
        want.append(np.log(len(xs[k]) / 700) - 0.5 * np.linalg.slogdet(cov)[1]
                    - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(m.log_odds(xs[1][:20]), want[1] - want[0])


def test_toxicity_held_out_accuracy(spark):
    from alphaloom.llm import toxicity
    docs, labels = table(spark, SF_CHECK.replace("0.01", "0.1"), "documents"), table(spark, SF_CHECK.replace("0.01", "0.1"), "labels")
    rows = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.98
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(caught) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_never_reads_held_out_labels(spark):
    from pyspark.sql import functions as F
    from alphaloom.llm import toxicity
    from alphaloom.llm.common import held_out
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    flipped = labels.withColumn("toxic", F.when(held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_documents(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-9)


def test_toxicity_edge_tables(spark):
    from alphaloom.llm import toxicity
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(i, 0, i % 2) for i in range(100, 180)] + [(None, 1, 0), (101, None, None)], LABELS)
    for labels in (none, some):
        rows = toxicity.score_documents(clashing(awkward(spark)), labels).collect()
        assert len(rows) == awkward(spark).count()
        assert all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    bad = spark.createDataFrame([(1, "you idiot", "en", "s", 9), (2, "a kind word", "en", "s", 11)], SCHEMA)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(bad, none).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.score_documents(spark.createDataFrame([], SCHEMA), some).collect() == []


def test_label_model_recovers_accuracies_and_discounts_copies():
    from alphaloom.llm import toxicity
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    def voter(p_toxic, p_clean):
        return np.where(rng.random(6000) < np.where(y, p_toxic, p_clean), 1, 0)
    a, b, weak = voter(0.9, 0.02), voter(0.7, 0.05), voter(0.5, 0.3)
    annotator = np.where(y, 1, -1)
    votes = np.stack([annotator, a, b, weak, weak, weak], axis=1).astype(float)
    model, q = toxicity.fit_label_model(votes, np.ones(6000))
    assert np.mean((q > 0.5) == y) > 0.98
    assert abs(model.tables[1][1, 2] - 0.9) < 0.05 and abs(model.tables[0][1, 2] - 0.02) < 0.02
    assert np.allclose(model.correlations[3, 4:], 1, atol=0.01) and abs(model.correlations[1, 2]) < 0.1


def noisy_labels(labels, share):
    from pyspark.sql import functions as F
    flip = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1000)) < int(share * 1000)
    return labels.withColumn("toxic", F.when(flip, 1 - F.col("toxic")).otherwise(F.col("toxic")))


def test_posteriors_come_from_the_voters_and_mend_wrong_labels(spark):
    """With a tenth of the labels flipped, the posteriors side with the truth, and the classifier trained on them
    beats the same classifier trained on the labels."""
    from alphaloom.llm import toxicity
    from alphaloom.llm.common import held_out
    folder = SF_CHECK.replace("0.01", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.fitted(docs, noisy_labels(labels, 0.1))
    differ = (found.posterior >= 0.5) != (found.labels >= 0.5)
    assert differ.mean() > 0.05
    test = [(truth[r.doc_id], r.text) for r in docs.where(held_out(5, 0)).collect() if r.doc_id in truth]
    y = np.array([t for t, _ in test])
    own, raw = (np.array([m.score(t) >= 0.5 for _, t in test]) for m in (found.linear(), found.linear(found.labels)))
    assert (own != raw).any()
    assert (own == y).mean() >= 0.98 and (own == y).mean() > (raw == y).mean() + 0.02


def test_own_label_does_not_vote(spark):
    """A row's votes come from other folds: they stay the same when all labels of its fold change."""
    from pyspark.sql import functions as F
    from alphaloom.llm import toxicity
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    sample, _ = toxicity.labelled_sample(docs, labels)
    rows = toxicity.term_counts(sample).collect()
    sizes = np.zeros((toxicity.FOLDS, 2))
    for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.fold, r.label] = r.n
    turned = sample.withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    swapped = sizes.copy()
    swapped[0] = sizes[0, ::-1]
    a, b = toxicity.lexicons_of(rows, sizes), toxicity.lexicons_of(toxicity.term_counts(turned).collect(), swapped)
    assert a[0] == b[0] and any(a[0].values()) and a[1] != b[1]


def test_toxicity_features_and_scores_against_a_plain_version(spark):
    """Terms, votes and scores of small texts, counted by hand-written loops."""
    from alphaloom.llm import toxicity as tx
    text = "Trash people trash-talk; ABCDEFG abcdefgh idiot!!! l@@er"
    words = {"trash", "people", "talk", "abcdefg", "abcdefgh", "idiot", "l", "er"}
    assert tx.words_of(text) == words
    want = {(0, w) for w in words}
    for k in (3, 4, 5, 6):
        begun = [w[:k] for w in words if len(w) > k]
        want |= {(k, p) for p in begun} | {(100 + k, p) for p in begun if begun.count(p) > 1}
    assert tx.terms_of(words) == want and (103, "abc") in want and (106, "abcdef") in want
    assert tx.pattern_votes(text, words) == [1, 1, 1, 1, 0]
    lexicon = {k: set() for k in tx.ALL_KINDS} | {0: {"trash", "idiot"}, 5: {"peopl"}, 104: {"abcd"}}
    assert tx.votes_of(words, [1, 1, 1, 1, 0], lexicon) == [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 0]
    none = {k: set() for k in tx.ALL_KINDS}
    assert tx.votes_of(set(), [0] * 5, none) == [0] * 14 + [-1, -1]
    terms = tx.Terms({0: {"trash": 0}, 3: {"abc": 1}, 4: {}, 5: {}, 6: {}})
    model = tx.Linear(terms, np.array([2.0, 0.5]), 1.5, -3.0)
    odds = -3.0 + 1.5 + 2.0 + 2 * 0.5
    assert abs(model.score(text) - 1 / (1 + np.exp(-odds))) < 1e-12
    assert abs(model.score("") - 1 / (1 + np.exp(3.0))) < 1e-12


def test_linear_fit_reaches_the_minimum():
    """The accelerated steps end where the gradient of the stated loss, formed anew, vanishes."""
    from collections import namedtuple
    from alphaloom.llm import toxicity as tx
    rng = np.random.default_rng(2)
    Row = namedtuple("Row", "insult numbers times")
    x = rng.integers(0, 3, size=(200, 6))
    rows = [Row(int(i % 3 == 0), np.flatnonzero(v).astype("<i4").tobytes(), v[v > 0].astype("<i4").tobytes()) for i, v in enumerate(x)]
    q, weights = rng.random(200), rng.random(200) + 0.5
    m = tx.fit_linear(rows, q, weights, tx.Terms.of([]), 6)
    full = np.column_stack([x, [r.insult for r in rows], np.ones(200)])
    w = np.r_[m.weights, m.insult, m.constant]
    miss = (1 / (1 + np.exp(-full @ w)) - q) * weights / weights.sum()
    assert np.abs(full.T @ miss + tx.RIDGE * np.r_[w[:-1], 0]).max() < 1e-4


def plain_features(text):
    """The 21 statistics from their names, character by character."""
    data = text.encode()
    n, words = len(data), data.split()
    w = len(words)
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()?-",
            b"#%&$*+/<=>@\\^_`{}~[]", b"!", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256))]
    sizes = [len(x) for x in words] or [0]
    mean = sum(sizes) / len(sizes)
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))
    pairs = list(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = [x for x in words if chr(x[-1]) not in string.ascii_letters + string.digits + ".,;:?" and x[-1] < 128]
    return [math.log(1 + n), math.log(1 + w), math.log(1 + mean), math.log(1 + spread),
            *[math.sqrt(sum(b in s for b in data) / max(n, 1)) for s in sets],
            math.log(1 + len(set(words))) / math.log(1 + w) if w else 1.0,
            math.sqrt(max([words.count(x) for x in set(words)] or [0]) / max(w, 1)),
            math.sqrt(sum(a == b for a, b in pairs) / max(w - 1, 1)),
            math.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
            math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
            math.sqrt(len(marked) / max(w, 1)), math.sqrt(sum(s <= 3 for s in sizes) / max(w, 1)),
            -sum(data.count(b) / n * math.log(data.count(b) / n) for b in set(data))]


def plain_log_odds(x, y, at, pooled_share, identity_share, temperature):
    """Quadratic discriminant fitted on (x, y), at rows ``at``, by determinants and solved systems."""
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    z, q = (x - centre) / scale, (at - centre) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    dens = []
    for k in (0, 1):
        cov = (1 - identity_share) * ((1 - pooled_share) * covs[k] + pooled_share * pooled) + identity_share * np.eye(x.shape[1])
        diff = q - z[y == k].mean(0)
        dens.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (diff * np.linalg.solve(cov, diff.T).T).sum(1))
    return (dens[1] - dens[0]) / temperature


def test_quality_scores_match_a_plain_recomputation(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == len(rows) == docs.count()
    x = {d: plain_features(t) for d, t in rows.items()}
    learn = [d for d in rows if known.get(d) in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1]
    part = np.array([xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest() % 4 == 0 for d in learn])
    xs, ys = np.array([x[d] for d in learn]), np.array([known[d] for d in learn])
    grid = [(p, i, t) for p in (0.05, 0.3, 0.7) for i in (0.01, 0.1, 0.4) for t in (1.0, 3.0, 10.0)]
    losses = [np.logaddexp(0, -(2 * ys[part] - 1) * plain_log_odds(xs[~part], ys[~part], xs[part], *g)).sum() for g in grid]
    ids = sorted(rows)
    odds = plain_log_odds(xs, ys, np.array([x[d] for d in ids]), *grid[int(np.argmin(losses))])
    want = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    assert np.allclose([got[d].score for d in ids], want, atol=1e-6)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in ids)
