"""Column functions: each takes columns and returns a column, so that Spark keeps them in its own execution."""
