"""slotwise: hourly zone-demand forecasting on Spark DataFrames.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame stages), ``plans``
(end-to-end jobs and the registered queries) and ``streaming``.
"""

__version__ = "0.1.0"
