"""Operators over rasters held as DataFrames of pixels."""
