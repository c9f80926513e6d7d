"""Paired-sample analytics on Spark: counting, comparing, filtering and scoring sites of two samples."""
