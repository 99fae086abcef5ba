"""Operators over DataFrames: relational, panel, spatial, raster, statistics, splits, scoring."""
