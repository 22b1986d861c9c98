"""Event analytics on Spark: envelopes, delivery, metrics, logs and config tables."""
