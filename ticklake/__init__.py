"""Market-data analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames over long ``(Symbol, Timestamp)``
tables.  ``plans`` holds the ordered-data kit the operators share, ``operators``
the operators, ``functions`` column expressions, ``sources`` scans, sinks and
stores, ``streaming`` the Structured Streaming forms, ``catalog`` the registered
queries with their SQL definitions.
"""
