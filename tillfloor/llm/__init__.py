"""Training-data operators: one module each, and their registered queries.

Nothing outside this subpackage and corpus_pipeline.py imports it. Functions that run in
Python workers travel by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
