"""shelfwise — retail catalogue analytics as Spark DataFrame / SQL jobs.

Layout:
  sources/    table scans, driver-table views, keyword / url imports, CSV / JSON sinks
  functions/  scalar Column builders (text, urls, numbers, dates, arrays, hashes)
  operators/  filters, joins, aggregates, windows, ordering, run comparison, upserts, page jobs
  plans/      end-to-end flows (ingest, dashboard, run comparison, rankings) and the query catalogue
  streaming/  Structured Streaming twins of the incremental computations
"""

__version__ = "0.1.0"
