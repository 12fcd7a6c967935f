"""Decision-record analytics on PySpark.

Worker-side functions are pickled by value, so executors need only the
libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
