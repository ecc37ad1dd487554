"""Operators that prepare training data for language models, one module each.

Their steps travel to the executors by value, so workers need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
