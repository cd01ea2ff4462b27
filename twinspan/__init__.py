"""Duplicated-region analytics over collections of long symbol sequences, on PySpark."""
