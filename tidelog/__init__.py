"""Event-log analytics on Spark: topics as tables, a stream DSL, log maintenance, connectors."""
