"""Whole analyses: inputs derived from the driver tables, the batch job, the query catalogue."""
