"""Operators for preparing language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Workers get the functions of this subpackage inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
