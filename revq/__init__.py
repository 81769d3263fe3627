"""revq — review analytics on Spark DataFrames.

Sub-packages: ``sources`` (tables, HTML pages, run logs), ``functions``
(Column expressions), ``operators`` (DataFrame -> DataFrame jobs), ``plans``
(composed reports and the query catalog), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
