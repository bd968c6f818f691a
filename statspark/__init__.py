"""Statistical analytics on Spark DataFrames.

``sources`` read and write, ``functions`` are column expressions, ``operators``
map DataFrames to DataFrames, ``plans`` chain operators into whole analyses and
``streaming`` holds the Structured Streaming variants.
"""
