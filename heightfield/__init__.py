"""heightfield: surface-metrology analytics over tables of height maps and curves, on PySpark.

Collections are :class:`~heightfield.model.ImageSet` and
:class:`~heightfield.model.CurveSet`: one long table of samples plus one catalog
row per image or curve.  Every operator takes a collection and returns a
collection or a plain DataFrame, as a lazy plan over all members at once.
"""

from heightfield.model import CurveSet, ImageSet, axis, channel

__all__ = ["CurveSet", "ImageSet", "axis", "channel"]

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions run on executors travel with the job, so a cluster needs no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
