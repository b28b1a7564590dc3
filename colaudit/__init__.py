"""Column-level data-minimisation audit on Spark."""
