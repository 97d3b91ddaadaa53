"""Column functions: everything here builds Catalyst expressions, no Python UDF."""
