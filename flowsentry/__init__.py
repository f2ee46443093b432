"""flowsentry: Spark-native flow telemetry analytics and detection.

Every operator is a ``DataFrame -> DataFrame`` function; the heavy work
runs as Spark jobs (scans, aggregates, joins, windows, streaming state).
"""

__version__ = "0.1.0"
