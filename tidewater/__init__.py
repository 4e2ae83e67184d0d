"""Tidewater: a time-series analytics engine expressed in PySpark."""
