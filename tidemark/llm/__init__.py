"""Training-data operators on text, token and embedding tables.

Each module holds one operator and its registered query; ``registry`` collects the queries.
Nothing outside this package imports it.
"""

from pyspark import cloudpickle

import tidemark

# Functions that run in Python workers travel with the task: executors need no copy of the code.
cloudpickle.register_pickle_by_value(tidemark)
