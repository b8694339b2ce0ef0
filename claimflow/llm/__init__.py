"""Operators for building language-model training data.

Nothing else in the library imports this package. Task code travels by value with the job, so
executors need numpy, pyarrow and the tokenizer libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
