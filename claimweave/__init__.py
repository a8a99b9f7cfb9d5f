"""Claimweave: a PySpark-native analytics engine over source-bound knowledge claims."""
