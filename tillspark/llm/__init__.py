"""Operators for building language-model training data.

Functions that run in tasks travel with their job, so executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
