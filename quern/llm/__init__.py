"""Operators for large training corpora.

Nothing else in the library imports this subpackage. Its functions travel to
the executors by value, so the executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
