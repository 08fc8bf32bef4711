"""Toxicity by weak supervision.

Labelled training rows are split in FOLDS parts.  The rows outside a part give lexicons, of whole words and of
word beginnings, that vote on the rows of the part; a fixed word list, patterns
and voters against vote too.  A row's own label is no vote and builds none of the voters that vote on it.
A generative label model takes the votes only: given the hidden label each voter has
its probabilities of voting (its accuracy), and the voters have correlations; both
are estimated by expectation-maximisation from the voters' majority, and voters that repeat each other are
not counted twice.  Its posterior labels train a linear classifier on the
occurring terms, which scores every whole text; a wrong label among many right ones so has little say.

The model is fitted on a bounded sample of labelled training rows
(``SAMPLE``).  Terms and votes are counted by Spark: what comes to the driver are the selected terms, one
row per vote pattern, and the sample's term numbers, each once per row, as packed arrays.  Scoring is one map.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, text_of

SAMPLE = {0: 14000, 1: 7000}    # labelled rows of each class the model is fitted on, at most (expected)
MIN_DOCS = 3                    # toxic sample rows a term of the classifier needs
LEXICON_DOCS = 5                # and a term of a lexicon
MIN_RATIO = 4.0                 # of a term's rates in toxic and clean rows
PURE = 0.9                      # precision of a lexicon's terms, were both labels equally common
COMMON = 0.02                   # part of the toxic rows that a lexicon's term is in
PREFIXES = (3, 4, 5, 6)
KINDS = (0, *PREFIXES)          # 0: whole word
RECURS = 100                    # added to a length: the beginning of two words or more of the row
ALL_KINDS = (*KINDS, *(RECURS + k for k in PREFIXES))
FOLDS = 4                       # parts of the sample: the rows outside one build the lexicons that vote on it
EM_STEPS, FIT_STEPS, RIDGE = 60, 1500, 1e-5

# A short list of common English insults.
INSULTS = ("clown", "coward", "creep", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile",
           "jerk", "liar", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")

_word = re.compile(r"[^\W\d_]+")
_masked = re.compile(r"\b[a-z][*@#]{2,}[a-z]*\b", re.I)
_shout = re.compile(r"\b[A-Z]{4,}\b")


def words_of(text: str) -> set[str]:
    return set(_word.findall(" ".join(set(text.lower().split()))))


def terms_of(words: set[str]) -> set[tuple[int, str]]:
    """(kind, term): each word, its beginning where the word is longer, and a beginning that recurs."""
    out = {(0, w) for w in words}
    for k in PREFIXES:
        begun = Counter(w[:k] for w in words if len(w) > k)
        out |= {(k, p) for p in begun} | {(RECURS + k, p) for p, n in begun.items() if n > 1}
    return out


def pattern_votes(text: str, words: set[str]) -> list[int]:
    """Votes of the fixed list and of patterns: 1 for toxic, 0 for none."""
    n = len(words)
    hits = len(words & set(INSULTS))
    return [int(hits > 0), int(hits > 1), int(bool(_masked.search(text))),
            int("!!!" in text), int(n > 0 and len(_shout.findall(text[:])) > n / 2)]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, fold, text) of sampled training rows, and the number of
    all training ids by label (repeated label rows count once).  The sampled ids number about sum(SAMPLE) at
    most, so the join broadcasts them."""
    rows = labels.where(~held_out(5, 0) & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).distinct()
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("label") == y, F.lit(int(min(1.0, SAMPLE[y] / n) * (1 << 20)))).otherwise(share)
    mixed = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    picked = rows.where(mixed < share)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int")
    found = own.join(F.broadcast(picked), "doc_id").select("doc_id", "label", fold.alias("fold"), "text")
    return materialize(found.dropDuplicates(["text", "label"]), "toxic-sample"), counts


def term_counts(sample: DataFrame) -> DataFrame:
    """(kind, term, n): sample rows with the term, by 2 * fold + label."""
    names = [f"n{x}" for x in range(2 * FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tallies = [Counter() for _ in names]
                for label, fold, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    tallies[2 * fold + label].update(terms_of(words_of(text)))
                every = list(set().union(*tallies))
                yield pa.record_batch([pa.array([k for k, _ in every], pa.int32()), pa.array([t for _, t in every], pa.string()),
                                       *(pa.array([t[x] for x in every], pa.int64()) for t in tallies)],
                                      names=["kind", "term", *names])
    rows = sample.select("label", "fold", "text").mapInArrow(run, "kind int, term string, " + ", ".join(f"{c} bigint" for c in names))
    return rows.groupBy("kind", "term").agg(F.array(*(F.sum(c) for c in names)).alias("n"))


def select_terms(counts: DataFrame, clean: int, toxic: int) -> list:
    """All terms that tell of toxic rows: in MIN_DOCS of them, and MIN_RATIO times as frequent there."""
    n0, n1 = (sum((F.get("n", F.lit(x)) for x in range(y, 2 * FOLDS, 2)), F.lit(0)) for y in (0, 1))
    ratio = (n1 / F.lit(float(max(toxic, 1)))) / ((n0 + 0.5) / F.lit(float(max(clean, 1))))
    return counts.where((n1 >= MIN_DOCS) & (ratio >= MIN_RATIO)).orderBy("kind", "term").collect()


@dataclass
class Terms:
    """Term numbers by kind: ``index[kind][term]``."""
    index: dict[int, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows) -> Terms:
        index = {k: {} for k in KINDS}
        for i, r in enumerate(rows):
            index[r.kind][r.term] = i
        return cls(index)

    def numbers(self, words: set[str]) -> list[int]:
        """Term numbers; a beginning counts once for each word that has it."""
        whole = self.index[0]
        found = [whole[w] for w in words if w in whole]
        for k in PREFIXES:
            index = self.index[k]
            if index:
                found += [index[w[:k]] for w in words if len(w) > k and w[:k] in index]
        return sorted(found)


def lexicons_of(rows, sizes: np.ndarray) -> list[dict[int, set[str]]]:
    """For each fold the lexicon of the rows outside it, by kind: the terms in LEXICON_DOCS and the part COMMON
    of their toxic rows (a rarer term may be there by chance) that are pure there, one clean row more
    counted.  ``sizes`` are the rows by fold and label."""
    totals = np.array([r.n for r in rows], float).reshape(-1, FOLDS, 2)
    totals, sizes = totals.sum(axis=1, keepdims=True) - totals, sizes.sum(axis=0) - sizes
    rates = (totals + [1.0, 0.0]) / np.maximum(sizes, 1)
    pure = rates[:, :, 1] / rates.sum(axis=2) >= PURE
    good = pure & (totals[:, :, 1] >= np.maximum(LEXICON_DOCS, COMMON * sizes[:, 1]))
    out = [{k: set() for k in ALL_KINDS} for _ in range(FOLDS)]
    for r, folds in zip(rows, good.tolist()):
        for fold in range(FOLDS):
            if folds[fold]:
                out[fold][r.kind].add(r.term)
    return out


def votes_of(words: set[str], patterns: list[int], lexicon: dict[int, set[str]]) -> list[int]:
    """All votes on a row, given the lexicon of the rows outside its fold: whether one, two and three of its words are
    in it, whole, by five or six letters, or by a beginning that recurs; whether two are by their
    whole, and two by each length of beginning; whether a beginning that recurs is; the
    patterns; and against (-1) where no word is in it or in the fixed list, and where at most one is."""
    whole = words & lexicon[0]
    begun = [{w for w in words if len(w) > k and w[:k] in lexicon[k]} if lexicon[k] else set() for k in PREFIXES]
    again = set()
    for k in PREFIXES[1:]:
        many = Counter(w[:k] for w in words if len(w) > k) if lexicon[RECURS + k] else {}
        hit = {p for p, n in many.items() if n > 1 and p in lexicon[RECURS + k]}
        again |= {w for w in words if len(w) > k and w[:k] in hit}
    found = len(whole.union(again, *begun[2:]))
    return [int(found >= 1), int(found >= 2), int(found >= 3), int(len(whole) > 1), *(int(len(b) > 1) for b in begun), int(bool(again)),
            *patterns, -int(found == 0 and not patterns[0]), -int(found <= 1 and not patterns[0])]


def voted_rows(sample: DataFrame, terms: Terms, lexicons: list[dict[int, set[str]]]) -> DataFrame:
    """The written sample without texts: label, votes (as text), and the row's term numbers with
    how often each counts, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, folds, texts = (batch.column(c).to_pylist() for c in range(3))
            words = [words_of(t) for t in texts]
            numbers = [terms.numbers(w) for w in words]
            fixed = [pattern_votes(t, w) for t, w in zip(texts, words)]
            votes = [",".join(map(str, votes_of(w, f, lexicons[x]))) for w, f, x in zip(words, fixed, folds)]
            tallies = [np.unique(np.array(n, np.int32), return_counts=True) for n in numbers]
            yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(votes, pa.string()), pa.array([f[0] for f in fixed], pa.int32()),
                                   pa.array([n.astype("<i4").tobytes() for n, _ in tallies], pa.binary()),
                                   pa.array([c.astype("<i4").tobytes() for _, c in tallies], pa.binary())],
                                  names=["label", "votes", "insult", "numbers", "times"])
    rows = sample.select("label", "fold", "text").mapInArrow(run, "label int, votes string, insult int, numbers binary, times binary")
    return materialize(rows, "toxic-votes")


def vote_patterns(voted: DataFrame, weight: dict[int, float]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pattern, its votes, its weight) of every vote pattern; the weight is the number of training rows
    that the sample's rows with it stand for."""
    found = {}
    for r in voted.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r.votes] = found.get(r.votes, 0.0) + r.n * weight[r.label]
    names = sorted(found)
    return names, np.array([list(map(int, v.split(","))) for v in names], float), np.array([found[v] for v in names])


@dataclass
class LabelModel:
    """Vote probabilities by hidden label, prior, and the voters' correlations
    given the label.  A voter's evidence counts by one over the sum of its
    correlations, so a group of voters that say the same counts about once."""
    prior: float
    tables: np.ndarray              # label x voter x (vote + 1)
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes.astype(int) + 1
        voter = np.arange(votes.shape[1])
        evidence = np.log(self.tables[1][voter, at] / self.tables[0][voter, at])
        share = 1 / np.abs(self.correlations).sum(axis=1)
        odds = np.log(self.prior / (1 - self.prior)) + evidence @ share
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def likelihood(self, votes: np.ndarray) -> np.ndarray:
        """Log-likelihood of vote patterns, every voter counted in full."""
        at, voter = votes.astype(int) + 1, np.arange(votes.shape[1])
        by = [np.log(p) + np.log(t[voter, at]).sum(axis=1) for p, t in zip((1 - self.prior, self.prior), self.tables)]
        return np.logaddexp(*by)

    def accuracies(self) -> np.ndarray:
        """How often a voter that does not abstain agrees with the hidden label."""
        right = self.prior * self.tables[1][:, 2] + (1 - self.prior) * self.tables[0][:, 0]
        wrong = self.prior * self.tables[1][:, 0] + (1 - self.prior) * self.tables[0][:, 2]
        return right / np.maximum(right + wrong, 1e-12)


def fit_label_model(votes: np.ndarray, weights: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """Expectation-maximisation over vote patterns and their weights.  It starts at the
    majority (a pattern is taken for toxic if more voters are for it than against), once with every voter
    and once with copies of a voter counted once; the likelier end is the result."""
    total = weights.sum()
    d = votes - weights @ votes / total
    together = (d * weights[:, None]).T @ d / total + 1e-6 * np.eye(votes.shape[1])
    spread = np.sqrt(np.diag(together))
    copies = (together / np.outer(spread, spread) > 0.99).sum(axis=1)
    ends = [_maximise(votes, weights, np.where(votes @ count > 0, 0.95, 0.05)) for count in (np.ones(len(copies)), 1 / copies)]
    return max(ends, key=lambda end: float(weights @ end[0].likelihood(votes)))


def _maximise(votes: np.ndarray, weights: np.ndarray, q: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    total, m = weights.sum(), votes.shape[1]
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(EM_STEPS):
        prior = float(np.clip((weights * q).sum() / total, 1e-3, 1 - 1e-3))
        tables, scatter = [], np.zeros((m, m))
        for share in (1 - q, q):
            w = weights * share
            seen = np.einsum("i,ijk->jk", w, one_hot) + 0.5
            tables.append(seen / seen.sum(axis=1, keepdims=True))
            d = votes - (w @ votes) / max(w.sum(), 1e-9)
            scatter += (d * w[:, None]).T @ d
        scatter = scatter / total + 1e-6 * np.eye(m)
        spread = np.sqrt(np.diag(scatter))
        model = LabelModel(prior, np.array(tables), scatter / np.outer(spread, spread))
        new = model.posterior(votes)
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-4:
            break
    return model, q


@dataclass
class Linear:
    """Weights of terms, of "any word of the fixed list", and the constant."""
    terms: Terms
    weights: np.ndarray
    insult: float
    constant: float

    def score(self, text: str) -> float:
        words = words_of(text)
        odds = self.constant + self.insult * (not words.isdisjoint(INSULTS)) + self.weights[self.terms.numbers(words)].sum()
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit_linear(rows, posterior: np.ndarray, weights: np.ndarray, terms: Terms, n_terms: int) -> Linear:
    """Logistic regression on posterior labels (cross-entropy with a ridge), by
    accelerated gradient steps over the sample's term numbers (rows: insult, numbers, times)."""
    numbers = [np.frombuffer(r.numbers, "<i4") for r in rows]
    extra = [np.array([n_terms + 1, n_terms][:1 + r.insult], np.int64) for r in rows]
    sizes = np.array([len(n) + len(e) for n, e in zip(numbers, extra)])
    columns = np.concatenate([x.astype(np.int64) for pair in zip(numbers, extra) for x in pair])
    times = np.concatenate([x for r, e in zip(rows, extra) for x in (np.frombuffer(r.times, "<i4"), np.ones(len(e), np.int32))]).astype(float)
    doc = np.repeat(np.arange(len(rows)), sizes)
    share = weights / weights.sum()
    length = np.bincount(doc, weights=times, minlength=len(rows))
    curvature = 0.25 * (share * length * np.bincount(doc, weights=times, minlength=len(rows))).sum() + RIDGE
    curvature = min(curvature, 0.25 * float((share[doc] * times * times.max() * sizes[doc]).sum()) + RIDGE)
    w = np.zeros(n_terms + 2)
    y, t, step = w, 1.0, 1.0 / curvature
    for _ in range(FIT_STEPS):
        odds = np.bincount(doc, weights=y[columns] * times, minlength=len(rows))
        miss = share * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - posterior)
        ridge = RIDGE * y
        ridge[-1] = 0
        nxt = y - step * (np.bincount(columns, weights=miss[doc] * times, minlength=len(w)) + ridge)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return Linear(terms, w[:n_terms], float(w[n_terms]), float(w[n_terms + 1]))


@dataclass
class Fitted:
    """What ``fitted`` learns from: the classifier's rows, their posteriors and labels, and the label model."""
    rows: list
    posterior: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    terms: Terms
    n_terms: int
    model: LabelModel

    def linear(self, targets: np.ndarray | None = None) -> Linear:
        return fit_linear(self.rows, self.posterior if targets is None else targets, self.weights, self.terms, self.n_terms)


def fitted(docs: DataFrame, labels: DataFrame) -> Fitted | None:
    """The label model and the rows for the classifier; None without sampled rows of both classes."""
    sample, counts = labelled_sample(docs, labels)
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.fold, r.label] = r.n
    clean, toxic = sizes.sum(axis=0)
    if not clean or not toxic:
        return None
    chosen = select_terms(term_counts(sample), clean, toxic)
    lexicons = lexicons_of(chosen, sizes)
    chosen = [r for r in chosen if r.kind in KINDS]         # the classifier counts a beginning for each word anyway
    terms = Terms.of(chosen)
    voted = voted_rows(sample, terms, lexicons)
    weight = {0: counts[0] / clean, 1: counts[1] / toxic}
    names, votes, weights = vote_patterns(voted, weight)
    model, q = fit_label_model(votes, weights)
    by = dict(zip(names, q))
    rows = voted.collect()
    return Fitted(rows, np.array([by[r.votes] for r in rows]), np.array([float(r.label) for r in rows]),
                  np.array([weight[r.label] for r in rows]), terms, len(chosen), model)


def train(docs: DataFrame, labels: DataFrame) -> Linear:
    """The classifier for ``labels.toxic``.  Without sampled rows of both classes
    it is the fixed list alone (0.9 with one of its words, else 0.1)."""
    found = fitted(docs, labels)
    if found is None:
        return Linear(Terms.of([]), np.zeros(1), 2 * np.log(9.0), -np.log(9.0))
    return found.linear()


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts hold no term and get the model's constant.  Rows that
    repeat an id are scored each; a null id has no label and is held out."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
