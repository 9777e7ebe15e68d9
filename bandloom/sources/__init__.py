"""Readers and writers of raster files, as Spark data sources and plain functions."""
