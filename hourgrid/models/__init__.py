"""Forecast models on ``pyspark.ml``."""
