"""Entity-relationship discovery over relational tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from relweave.sources.catalog import Catalog, EntityTable, ForeignKey

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Catalog", "EntityTable", "ForeignKey"]
