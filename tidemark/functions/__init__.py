"""Column functions: content-addressed ids, names and element parts."""
