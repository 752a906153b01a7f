"""Scalar-field topology on Spark: grids, filtrations, trees, meshes and their queries as DataFrame jobs."""
