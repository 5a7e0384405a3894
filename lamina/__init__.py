"""Versioned, content-addressed tables expressed as PySpark DataFrames."""
