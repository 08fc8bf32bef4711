"""The post features computed on a stream equal the batch features."""

import os

from alphaloom.session import scratch_path
from alphaloom.sources import fixtures as fx
from alphaloom.operators import text as te
from alphaloom.streaming import posts as sp

from .conftest import SF_SMALL


def test_stream_matches_batch(spark):
    src = scratch_path(spark, "posts_in")
    out = scratch_path(spark, "posts_out")
    ckpt = scratch_path(spark, "posts_ckpt")
    posts = fx.tweets(spark, SF_SMALL)
    posts.repartition(4).write.mode("overwrite").parquet(src)
    q = sp.start_feature_sink(sp.post_features(sp.post_stream(spark, src, max_files=2)), out, ckpt)
    q.awaitTermination(120)
    assert q.exception() is None
    streamed = spark.read.parquet(out)
    batch = te.word_features(posts).select(*streamed.columns)
    assert streamed.count() == posts.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert os.path.isdir(ckpt.replace("file:", ""))
