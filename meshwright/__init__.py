"""Spark jobs for gridded-series statistics, acquisition ledgers and log alerts."""
