"""Column expressions: paths, geometry, arrays of points."""
