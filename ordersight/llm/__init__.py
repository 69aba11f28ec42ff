"""Operators of a training-data pipeline over document and page tables.

One module per operator; ``registry`` holds the query and oracle tables that
``__spark_entry__`` adds.  Nothing else in the library imports this package.

Python functions that run on executors are pickled by value, so workers need no
installed copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
