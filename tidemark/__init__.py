"""Incremental feed and page analytics on PySpark."""
