"""Part of slidegrid."""
