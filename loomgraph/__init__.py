"""Analytics over catalogues of callable tools, their graphs, walks and interaction logs, on Spark.

Importing the package registers it with Spark's pickler, so that functions
shipped to Python workers carry their code and executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
