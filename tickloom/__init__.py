"""Market time-series analytics on Spark: scans, calendar sessions, features, targets, validation and evaluation."""
