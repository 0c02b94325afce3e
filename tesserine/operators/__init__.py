"""Array operators: reductions, scans, sorting, sets, contractions, transforms."""
