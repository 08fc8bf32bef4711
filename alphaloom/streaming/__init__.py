"""Incremental forms of the row-level operators.

The reference has no streaming jobs.  The post features (cleaning, word-list
scores) are stateless row expressions, so the same Column expressions run
unchanged on a streaming DataFrame; see ``posts.py``.  Operators that need a
global statistic (min-max scaling, z-scores, percentiles) stay batch jobs.
"""
