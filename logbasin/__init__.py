"""Access-log analytics on Spark: parse, classify, store, query and alarm."""

__version__ = "0.1.0"
