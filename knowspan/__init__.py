"""Knowspan: a PySpark-native analytics engine for text collections and the logs of their use."""
