"""The named queries with their SQL twins, one module per topic."""
