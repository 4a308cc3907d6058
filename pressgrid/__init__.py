"""News-coverage analytics as Spark DataFrame operators.

Every operator is a function of DataFrames (and an explicit ``as_of`` time)
that returns a DataFrame.  See README.md for the layout and the rules the
operators follow at scale.
"""

import sys

from pyspark import cloudpickle

# Pandas UDFs carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
