"""Fare intelligence on Spark: scans, features, signals, ledgers and streams over tables of any size."""
