"""pacegrid: study-progress analytics expressed as Spark DataFrame operators.

Every operator takes DataFrames (and plain parameters such as an ``as_of``
date) and returns a DataFrame.  Nothing is collected to the driver; all work
is planned by Catalyst and run by Spark executors.
"""

__all__ = ["session"]
