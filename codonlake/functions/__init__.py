"""Column functions over DNA and protein strings."""
