"""Sky-survey analytics on PySpark: named queries, column libraries and aggregates."""
