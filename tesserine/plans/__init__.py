"""The array abstraction: shape and type on the driver, cells in a DataFrame."""
