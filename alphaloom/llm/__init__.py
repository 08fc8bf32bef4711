"""Operators of a training-data pipeline.

Each module holds one operator; ``queries`` registers them over the given
tables.  Nothing outside this subpackage imports it, except the guarded
import in ``__spark_entry__.py``.
"""
