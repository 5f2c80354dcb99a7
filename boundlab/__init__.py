"""Analytics on interval-valued (censored) labels, written as Spark DataFrame programs.

Functions that run in Spark's Python workers are shipped with the job, so the
package has to be installed on the driver alone.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
