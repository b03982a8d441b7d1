"""Structured Streaming: stateful operators, dead letters, retries, workers."""
