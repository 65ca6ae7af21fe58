"""Batch and streaming jobs for relationship data on Spark."""
