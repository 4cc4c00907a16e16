"""Spark-native analytics for industrial sensor streams.

Layers, bottom up: ``functions`` (column expressions), ``sources`` and ``sinks`` (tables in and
out), ``operators`` (DataFrame -> DataFrame), ``streaming`` (the same operators on live input)
and ``plans`` (whole jobs and the query catalog).
"""
