"""Training-data operators over tables of texts. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions sent to tasks carry their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
