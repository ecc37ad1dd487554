"""Readers and sinks. Their steps travel to the workers by value, which need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
