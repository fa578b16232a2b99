"""Column functions; every one takes a Column or a column name."""
