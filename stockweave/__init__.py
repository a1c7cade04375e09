"""Stockweave: batch table operators for a make-and-ship business on PySpark."""
