"""basketlens: retail analytics operators expressed as Spark DataFrame plans.

Every operator takes DataFrames plus column names / parameters and returns a
lazy DataFrame. Heavy work runs as Spark aggregations, joins and windows; the
driver only ever sees bounded results (one-row statistics, fitted models).
"""

__version__ = "0.1.0"
