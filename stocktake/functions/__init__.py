"""Column functions and small parsers of texts."""
