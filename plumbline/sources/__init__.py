"""Where tables, keys, claims and earlier runs come from, and where results go."""
