"""Drive-test analytics on Spark: cleaning, ordered features, labels, models, retrieval."""

import sys

from pyspark import cloudpickle

from radiolens.plans.ordered import LogOrder
from radiolens.session import local_session

__all__ = ["LogOrder", "local_session"]

# What tasks run travels to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
