"""Operators for training-data pipelines over a corpus of documents.

Nothing outside this subpackage imports it.  Python code sent to executors is
pickled by value, so a cluster needs no copy of this package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
