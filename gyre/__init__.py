"""Spark operators for ordered, cyclic measurement sequences and their catalogue."""

__version__ = "0.1.0"
