"""assaykit: lazy PySpark operators for assay measurements, training sets and run reports.

Every operator takes DataFrames and returns a DataFrame without triggering an
action, so callers compose them and Catalyst plans the whole job at once.
"""

from assaykit.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
