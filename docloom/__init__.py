"""docloom: document analytics and grounded retrieval, declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code with them, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
