"""Keyed market-data analytics on Spark DataFrames.

Sub-packages:

* ``functions``  - column expressions (numeric, time, window frames)
* ``operators``  - ``DataFrame -> DataFrame`` building blocks
* ``sources``    - readers, payload parsers and sinks
* ``plans``      - compositions: feature table, model training, daily job
* ``streaming``  - Structured Streaming forms of the tick operators
"""
