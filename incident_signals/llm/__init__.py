"""Training-data operators over the document, page and benchmark tables."""

import sys

from pyspark import cloudpickle

# Code that runs inside tasks travels with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
