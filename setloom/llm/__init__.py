"""Operators for preparing training text at corpus scale.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present. Functions of this
package travel to the executors by value, so that workers need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
