"""Telemetry, stint and strategy analytics on Spark DataFrames."""
