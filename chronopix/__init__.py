"""Irregular multi-band time-series reconstruction on PySpark."""
