"""Raster and scan analytics on Spark: images are pixel relations, steps are DataFrame operators."""
