"""Column functions: names, time, grids, vectors, geometry and payload bytes."""
