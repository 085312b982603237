"""Field phenotyping analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver unless its size is bounded by the definition of the operator.
"""

import sys

from pyspark import cloudpickle

# The functions run in Python workers travel with the tasks, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
