"""Post features and the post alpha.

Plan shape: cleaning, word-list and lexicon scores are row expressions over the
token array, so posts are never joined, shuffled or keyed.  Stock volume is
aggregate-then-join, its moments are scalar subqueries, and the bounds of the post alpha
are observed while the features are written, so each post is cleaned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from .normalize import attach_bounds, minmax_zero

# Post-alpha weights.
TWEET_WEIGHTS = [("sent_norm", 0.4), ("fear_norm", 0.3), ("keyword_norm", 0.2), ("volume_norm", 0.1)]
FEATURE_NORMS = [("sentiment", "sent_norm"), ("fear_score", "fear_norm"),
                 ("finance_keyword_score", "keyword_norm"), ("volume_zscore", "volume_norm")]

def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def word_features(posts: DataFrame, text_col: str = "Tweet") -> DataFrame:
    """T1-T3 as columns ``clean``, ``tokens``, ``fear_score``,
    ``finance_keyword_score``."""
    return (posts.withColumn("clean", tx.clean_post(_c(text_col)))
                 .withColumn("tokens", tx.tokens(F.col("clean")))
                 .withColumn("fear_score", tx.fear_score(F.col("tokens")))
                 .withColumn("finance_keyword_score", tx.keyword_score(F.col("tokens"))))


def lexicon_sentiment(feat: DataFrame, lexicon: dict[str, float], negation: bool = False) -> DataFrame:
    """T4: compound polarity of the summed token valences; no hit -> 0.0.

    ``lexicon`` is a word list like the others (word -> valence, case ignored):
    a constant of the plan.  Tokens are tested against a hash set of its words,
    and only hits are looked up, so the cost does not grow with the list.  NULL
    tokens are ignored; posts need no key.  ``negation=True`` scales a valence by
    ``NEGATION_FACTOR`` when one of the three preceding tokens is a negation word."""
    values: dict[str, float] = {}
    for word, value in lexicon.items():
        values[word.lower()] = values.get(word.lower(), 0.0) + float(value)
    if not values:
        return feat.withColumn("sentiment", F.lit(0.0))
    table = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])

    def valence(t: Column) -> Column:
        return F.when(t.isin(*values), F.try_element_at(table, t)).otherwise(F.lit(0.0))
    scores = F.transform("tokens", valence)
    if negation:
        scores = F.zip_with(scores, tx.negation_multipliers(F.col("tokens")), lambda v, m: v * m)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + v)
    return feat.withColumn("sentiment", tx.compound(F.coalesce(total, F.lit(0.0))))


def stock_volume(posts: DataFrame, stock: str = "Stock Name", text_col: str = "Tweet") -> DataFrame:
    """Per stock, ``n`` rows and ``c`` non-NULL posts (aggregate first;
    the per-stock table is joined back where needed)."""
    return (posts.where(_c(stock).isNotNull())
            .groupBy(_c(stock).alias(stock))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count(_c(text_col)).alias("volume")))


def volume_moments(per_stock: DataFrame) -> DataFrame:
    """Row-weighted mean and sample std of the per-row stock volume,
    from exact integer sums: N = sum n, S1 = sum n*c, S2 = sum n*c^2,
    var = (N*S2 - S1^2) / (N*(N-1))."""
    dec = "decimal(38,0)"
    n, c = F.col("n_rows").cast(dec), F.col("volume").cast(dec)
    agg = per_stock.agg(F.sum(n).alias("N"), F.sum(n * c).alias("S1"), F.sum(n * c * c).alias("S2"))
    N, S1, S2 = F.col("N"), F.col("S1"), F.col("S2")
    var = F.try_divide((N * S2 - S1 * S1).cast("double"), (N * (N - 1)).cast("double"))
    return agg.select(F.try_divide(S1.cast("double"), N.cast("double")).alias("volume_mean"),
                      F.when(N > 1, F.sqrt(var)).alias("volume_std"))


def volume_zscore(posts: DataFrame, stock: str = "Stock Name", text_col: str = "Tweet") -> DataFrame:
    """(stock volume - mean) / std on every post row; NULL stock or a
    zero std gives NULL."""
    per_stock = stock_volume(posts, stock, text_col)
    mom = volume_moments(per_stock)
    mean, std = mom.select("volume_mean").scalar(), mom.select("volume_std").scalar()
    vol = per_stock.select(_c(stock).alias("_stock"), "volume")
    out = posts.join(vol, _c(stock) == F.col("_stock"), "left").drop("_stock")
    return out.withColumn("volume_zscore", F.try_divide(F.col("volume") - mean, F.nullif(std, F.lit(0.0))))


def tweet_features(posts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """T1-T4 + N4 on every post."""
    return volume_zscore(lexicon_sentiment(word_features(posts), lexicon)).drop("tokens")


def tweet_alpha(features: DataFrame, write: bool = True) -> DataFrame:
    """N3 on the four features (constant column -> 0.0), then T5.

    With ``write`` the features are computed once: they are written to the shared folder
    (this starts a job), and the four minima and maxima are observed while they
    are.  Without it nothing is written, and every post is cleaned and scored twice, once for the bounds."""
    srcs = [src for src, _ in FEATURE_NORMS]
    if write:
        seen = Observation("feature-bounds")
        aggregates = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in srcs for n, f in (("min", F.min), ("max", F.max))]
        feat = materialize(features.observe(seen, *aggregates), "post-features")
        bounds = {k: F.lit(v).cast("double") for k, v in seen.get.items()}
    else:
        feat = attach_bounds(features, "_bounds", features.select(*srcs), srcs)
        bounds = {f"{c}_{n}": F.col("_bounds")[f"{c}_{n}"].cast("double") for c in srcs for n in ("min", "max")}
    feat = feat.withColumns({dst: minmax_zero(F.col(src).cast("double"), bounds[f"{src}_min"], bounds[f"{src}_max"])
                             for src, dst in FEATURE_NORMS}).drop("_bounds")
    score = None
    for c, w in TWEET_WEIGHTS:
        term = F.lit(w) * F.col(c)
        score = term if score is None else score + term
    return feat.withColumn("tweet_alpha", score)


def rename_stock_columns(df: DataFrame) -> DataFrame:
    """C5 for posts: spaces in the stock and company column names."""
    return df.withColumnsRenamed({"Stock Name": "Stock_Name", "Company Name": "Company_Name"})
