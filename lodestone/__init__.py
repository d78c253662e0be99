import sys

from pyspark import cloudpickle

# Workers get the library's functions inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
