"""Registered queries: post features, post alpha, memo text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import text as te
from ..sources import fixtures as fx
from ..sources.tables import scan_table
from .registry import register


def _posts(spark, base):
    return fx.tweets(spark, base)


def _features(spark, base):
    return te.tweet_features(_posts(spark, base), dict(fx.LEXICON))


@register("clean_tweet", "doc_id, clean", "FROM tweet_words", ctes=("tweet_words",))
def q_clean(spark, base):
    return te.word_features(_posts(spark, base))


@register("fear_score", "doc_id, fear_score:d", "FROM tweet_words", ctes=("tweet_words",))
def q_fear(spark, base):
    return te.word_features(_posts(spark, base))


@register("finance_keyword_score", "doc_id, finance_keyword_score", "FROM tweet_words",
          ctes=("tweet_words",))
def q_keywords(spark, base):
    return te.word_features(_posts(spark, base))


@register("lexicon_sentiment", "doc_id, sentiment:d", "FROM tweet_sent", ctes=("tweet_sent",))
def q_sentiment(spark, base):
    feat = te.word_features(_posts(spark, base))
    return te.lexicon_sentiment(feat, dict(fx.LEXICON))


@register("stock_volume", "doc_id, volume",
          "FROM tweets t LEFT JOIN stock_vol v ON v.stock = t.\"Stock Name\"",
          ctes=("tweets", "stock_vol"))
def q_stock_volume(spark, base):
    posts = _posts(spark, base)
    vol = te.stock_volume(posts).select(F.col("Stock Name").alias("_s"), "volume")
    return posts.join(vol, posts["Stock Name"] == vol["_s"], "left")


@register("volume_moments", "volume_mean:d, volume_std:d", "FROM vol_moments", ctes=("vol_moments",))
def q_volume_moments(spark, base):
    return te.volume_moments(te.stock_volume(_posts(spark, base)))


@register("volume_zscore", "doc_id, volume_zscore:d", "FROM tweet_feat", ctes=("tweet_feat",))
def q_volume_zscore(spark, base):
    return te.volume_zscore(_posts(spark, base))


@register("minmax_zero", "doc_id, sent_norm:d, fear_norm:d, keyword_norm:d, volume_norm:d",
          "FROM tweet_scored", ctes=("tweet_scored",))
def q_minmax_zero(spark, base):
    return te.tweet_alpha(_features(spark, base))


@register("tweet_alpha",
          "doc_id, Stock_Name, Company_Name, clean, sentiment:d, fear_score:d, finance_keyword_score, "
          "volume_zscore:d, tweet_alpha:d",
          'FROM (SELECT * RENAME ("Stock Name" AS Stock_Name, "Company Name" AS Company_Name) '
          'FROM tweet_scored)', ctes=("tweet_scored",))
def q_tweet_alpha(spark, base):
    return te.rename_stock_columns(te.tweet_alpha(_features(spark, base)))


@register("clean_memo_text", "doc_id, clean_text",
          r"""FROM (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(text,
                 '\*\*([^\n]*?)\*\*', '\1', 'g'), '\*([^\n]*?)\*', '\1', 'g'), '#', ''),
                 '[^\x{00}-\x{FF}]', '', 'g') AS clean_text FROM documents)""")
def q_clean_memo(spark, base):
    """T6 over whole documents (markdown markers and non-Latin-1 removed)."""
    d = scan_table(spark, base, "documents").select("doc_id", "text")
    return d.select("doc_id", tx.clean_memo(F.col("text")).alias("clean_text"))
