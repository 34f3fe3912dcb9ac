"""Readers and writers: landed files to DataFrames with the types of ``schemas``."""
