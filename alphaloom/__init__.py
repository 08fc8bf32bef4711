"""alphaloom: equity and retail signal analytics as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python functions this package hands to Spark (such as the memo batch's mapInPandas
# body) are shipped to the workers by value, so
# executors need no copy of the package on their path.
try:  # pragma: no cover - depends on the installed PySpark
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
