"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions that run on
executors travel by value, so executors need no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
