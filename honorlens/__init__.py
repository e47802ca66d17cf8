"""honorlens: award-record analytics re-expressed as Spark DataFrame / SQL / ML jobs.

Layout: ``sources`` (scans, bindings, sinks), ``functions`` (column helpers, tails),
``operators`` (reports, statistics, enrichment, search, ML, forecasting),
``plans`` (registered queries and their SQL oracles), ``streaming`` (page ingest).
"""

__version__ = "0.1.0"
