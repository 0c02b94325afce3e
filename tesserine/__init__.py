"""N-dimensional array analytics as lazy Spark plans."""
