"""Readers and writers. Files are opened by Spark, so any store that Spark reads will do."""
