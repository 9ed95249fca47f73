"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  The functions that run on executors
are shipped by value, so a cluster needs no copy of the package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
