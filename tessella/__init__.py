"""tessella: record linkage and corpus analytics as lazily composed Spark plans.

Python functions of this package that run inside Spark tasks are shipped by value, so executors need no
installation of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
