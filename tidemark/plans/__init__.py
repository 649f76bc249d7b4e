"""Plans made of several operators: running a rule register on a catalog of tables."""
