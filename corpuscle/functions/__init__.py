"""Column functions over texts, ids and lists."""
