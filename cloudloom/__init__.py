"""Point-cloud analytics as plain Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from cloudloom.session import build_session, cut_lineage

# Functions sent to Python workers travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
