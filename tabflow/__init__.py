"""DataFrame operators for tabular and time-series analytics on Spark."""
