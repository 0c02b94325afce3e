"""Column functions: element-wise operators under IEEE-754 rules."""
