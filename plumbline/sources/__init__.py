"""Readers that turn files of many formats into DataFrames with a stable row order."""
