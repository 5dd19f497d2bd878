"""Training-data operators (deduplication, filtering, extraction, packing).

Nothing else in the library imports this package. Its functions run inside
Python workers, so the package is pickled by value: a cluster needs no copy of
it on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
