"""textpairs - question/answer text corpora on Spark: ingest, profile, encode, split, batch, score.

Layout: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``sources`` (files and tables in and out), ``streaming`` (incremental ingest),
``plans`` (composite flows, cluster jobs and the query catalogue).
"""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the mapInPandas kernels and
# predictors) are shipped by value, so executors need pyspark, numpy and pandas but not
# this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: the package must then be importable on the workers
    pass
