"""Column helpers. All of them are built-in expressions; there is no UDF."""
