"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics (log counts, square-root
shares) of its whole text.  The class means and covariances come from sums over all
labelled training rows, added up by Spark; only those sums (a few hundred
numbers) reach the driver.  A class covariance is shrunk towards the pooled one
and then towards the identity of the standardised features; strengths and
temperature are chosen on a quarter of the training rows, and the fit is then
repeated on all of them.  A score is the logistic of the difference of the two
log-densities, each from a Mahalanobis distance by a cached Cholesky factor.
Ids, languages, sources and labels are never features.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, text_of

POOLED_SHARES = (0.05, 0.3, 0.7)
IDENTITY_SHARES = (0.01, 0.1, 0.4)
TEMPERATURES = (1.0, 3.0, 10.0)

FEATURES = ["log_chars", "log_words", "log_mean_word", "word_spread", "upper", "lower", "digits", "stops",
            "marks", "exclaims", "bars", "spaces", "beyond_ascii", "variety", "top_word", "echo",
            "bigram_repeat", "line_repeat", "marked_words", "short_words", "letter_entropy"]
_CLASSES = {"upper": rb"A-Z", "lower": rb"a-z", "digits": rb"0-9", "stops": rb".,;:'\"()?-",
            "marks": rb"#%&$*+/<=>@\\^_`{}~\[\]", "exclaims": rb"!", "bars": rb"|", "spaces": rb" \t\n\r\x0b\x0c",
            "beyond_ascii": rb"\x80-\xff"}


def byte_classes() -> np.ndarray:
    """256 x classes membership matrix."""
    every = bytes(range(256))
    return np.stack([np.bincount(np.frombuffer(b"".join(re.findall(b"[" + c + b"]", every)), np.uint8),
                                 minlength=256) for c in _CLASSES.values()], axis=1).astype(float)


def statistics(data: bytes, classes: np.ndarray) -> list[float]:
    """The feature vector of one text in UTF-8 (empty texts included)."""
    n = len(data)
    words = data.split()
    w = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256)
    shares = np.sqrt((counts @ classes) / max(n, 1)).tolist()
    lengths = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1)
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?" for x in words)
    letters = counts[counts > 0] / max(n, 1)
    return [math.log1p(n), math.log1p(w), math.log1p(lengths.mean()), math.log1p(lengths.std()), *shares,
            math.log1p(len(tally)) / math.log1p(w) if w else 1.0,
            math.sqrt(max(tally.values(), default=0) / max(w, 1)),
            math.sqrt(sum(map(eq, words, words[1:])) / max(w - 1, 1)),
            math.sqrt(1 - len(set(zip(words, words[1:]))) / (w - 1)) if w > 1 else 0.0,
            math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
            math.sqrt(marked / max(w, 1)), math.sqrt((lengths <= 3).sum() / max(w, 1)),
            float(-(letters * np.log(letters)).sum()) if n else 0.0]


def feature_rows(column: pa.Array) -> np.ndarray:
    classes = byte_classes()
    return np.array([statistics(x.as_py(), classes) for x in column.cast(pa.binary())]).reshape(-1, len(FEATURES))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): one row per document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(1))
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                                  names=["doc_id", "x"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")) \
        .mapInArrow(run, "doc_id bigint, x array<double>")


def feature_udf():
    """The features of a text column's rows, as an Arrow function."""
    @F.arrow_udf("array<double>")
    def of_texts(text: pa.Array) -> pa.Array:
        x = feature_rows(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return of_texts


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass
class ClassSums:
    """Row count, sum and sum of outer products of one class."""
    n: float
    s: np.ndarray
    ss: np.ndarray

    def mean(self):
        return self.s / self.n

    def cov(self):
        m = self.mean()
        return self.ss / self.n - np.outer(m, m)


def class_sums(rows: DataFrame) -> dict[tuple[int, bool], ClassSums]:
    """Sums by (label, check) of rows (label, check, x), added up by Spark."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, check = (np.asarray(batch.column(c).to_pylist(), int) for c in (0, 1))
            x = matrix(batch.column(2))
            x1 = np.hstack([np.ones((len(x), 1)), x])
            for y, c in itertools.product((0, 1), (0, 1)):
                part = x1[(label == y) & (check == c)]
                if len(part):
                    total = (part.T @ part).ravel()
                    yield pa.record_batch([pa.array([y] * total.size, pa.int32()), pa.array([c] * total.size, pa.int32()),
                                           pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total)],
                                          names=["label", "part", "cell", "value"])
    cells = rows.mapInArrow(run, "label int, part int, cell int, value double") \
        .groupBy("label", "part", "cell").agg(F.sum("value").alias("value")).collect()
    sums: dict = {}
    for r in cells:
        sums.setdefault((r.label, bool(r.part)), np.zeros((d + 1) ** 2))[r.cell] = r.value
    out = {}
    for key, v in sums.items():
        v = v.reshape(d + 1, d + 1)
        out[key] = ClassSums(v[0, 0], v[0, 1:].copy(), v[1:, 1:].copy())
    return out


@dataclass
class Discriminant:
    """Two Gaussians over standardised features with cached Cholesky factors;
    without rows of both classes, a constant score."""
    constant: float | None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list | None = None
    factors: list | None = None     # inverse Cholesky factors
    offsets: list | None = None     # log prior minus half the log determinant
    temperature: float = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), math.log(self.constant / (1 - self.constant)))
        z = (x - self.centre) / self.scale
        dens = [b - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1)
                for m, f, b in zip(self.means, self.factors, self.offsets)]
        return (dens[1] - dens[0]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(sums: list[ClassSums | None], pooled_share: float, identity_share: float, temperature: float) -> Discriminant:
    """Regularised fit from the sums of classes 0 and 1."""
    counts = [0 if s is None else s.n for s in sums]
    if min(counts) < 2:
        return Discriminant((counts[1] + 1) / (sum(counts) + 2))
    total = ClassSums(sum(counts), sums[0].s + sums[1].s, sums[0].ss + sums[1].ss)
    centre, scale = total.mean(), np.sqrt(np.maximum(np.diag(total.cov()), 1e-8))
    covs = [s.cov() / np.outer(scale, scale) for s in sums]
    pooled = (covs[0] * counts[0] + covs[1] * counts[1]) / sum(counts)
    means, factors, offsets = [], [], []
    for s, c in zip(sums, covs):
        shrunk = (1 - pooled_share) * c + pooled_share * pooled
        shrunk = (1 - identity_share) * shrunk + identity_share * np.eye(len(c))
        chol = np.linalg.cholesky(shrunk)
        means.append((s.mean() - centre) / scale)
        factors.append(np.linalg.inv(chol))
        offsets.append(math.log(s.n / sum(counts)) - np.log(np.diag(chol)).sum())
    return Discriminant(None, centre, scale, means, factors, offsets, temperature)


def add_sums(a: ClassSums | None, b: ClassSums | None) -> ClassSums | None:
    if a is None or b is None:
        return a or b
    return ClassSums(a.n + b.n, a.s + b.s, a.ss + b.ss)


def check_losses(rows: DataFrame, models: list[Discriminant]) -> list[float]:
    """Log-loss of each model over rows (label, x), added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = np.asarray(batch.column(0).to_pylist(), float), matrix(batch.column(1))
            loss = [float(np.logaddexp(0, -(2 * label - 1) * m.log_odds(x)).sum()) for m in models]
            yield pa.record_batch([pa.array(range(len(models)), pa.int32()), pa.array(loss)], names=["model", "loss"])
    got = rows.mapInArrow(run, "model int, loss double").groupBy("model").agg(F.sum("loss").alias("loss")).collect()
    by = {r.model: r.loss for r in got}
    return [by.get(i, 0.0) for i in range(len(models))]


def train(feature_table: DataFrame, labels: DataFrame, learn: Column, target: str = "quality") -> Discriminant:
    """Fit on all rows of ``labels`` where ``learn`` holds and the label is 0 or 1
    (repeated label rows count once)."""
    wanted = labels.where(learn & F.col(target).isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label")).distinct()
    rows = feature_table.join(wanted, "doc_id")
    check = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int")
    rows = materialize(rows.select("label", check.alias("part"), "x"), "quality-train")
    sums = class_sums(rows)
    part = [sums.get((y, False)) for y in (0, 1)]
    grid = list(itertools.product(POOLED_SHARES, IDENTITY_SHARES, TEMPERATURES))
    losses = check_losses(rows.where("part = 1").select("label", "x"), [fit(part, *g) for g in grid])
    best = grid[int(np.argmin(losses))]
    return fit([add_sums(part[y], sums.get((y, True))) for y in (0, 1)], *best)


def learn_rows() -> Column:
    """Training rows: crc32 of the id as text, modulo 3, is not 1."""
    return ~held_out(3, 1)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts have a feature vector of their own and get a score; very long texts
    are read whole; other columns are ignored; an empty table gives no rows.
    Rows that repeat an id are scored each; a null id has no label and is held
    out.  With fewer than two training rows of a class every score is the
    smoothed share of label 1."""
    table = materialize(features(docs), "quality-features")
    model = train(table, labels, learn_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])
    scored = table.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows scored 0.5 or more, with all columns and without a shuffle of texts.

    Features are taken once and written beside the rows (in a column of a name that ``docs``
    does not have); the fit reads the features only.  Nulls, empty and very long texts and
    repeated ids as in ``score_documents``; other columns of any name are kept; an empty
    table gives an empty one."""
    name = "features"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    rows = materialize(docs.withColumn(name, feature_udf()(text_of())), "quality-rows")
    model = train(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).alias("x")), labels, learn_rows())

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(x)))
    return rows.where(score(name) >= 0.5).select(*docs.columns)
