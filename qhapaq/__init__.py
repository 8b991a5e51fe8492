"""Qhapaq: road-access analytics and training-data operators on Spark DataFrames."""
