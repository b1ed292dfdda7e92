"""Operators of a training-data pipeline.  Nothing outside this subpackage imports it."""

from pyspark import cloudpickle as _cloudpickle
import logweave as _root

# Executors get the functions themselves, so the package need not be installed on them.
_cloudpickle.register_pickle_by_value(_root)
