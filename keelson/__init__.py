"""Keelson: bulk memory-record analytics on Spark DataFrames."""
