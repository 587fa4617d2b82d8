"""PySpark toolkit for building and judging visual-grounding data sets.

``functions``  column expressions (geometry, text parsing, seeded hashes)
``operators``  DataFrame -> DataFrame jobs (joins, windows, sets, statistics)
``sources``    typed schemas, readers, sinks, ledgers, the answer cache
``streaming``  incremental stages and running metrics
``plans``      the registered queries and the SQL they are checked against
"""
