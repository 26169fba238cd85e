"""Terrain-contour analytics on Spark: DataFrame operators over nodes, ways, relations and raster cells."""
