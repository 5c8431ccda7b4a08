"""Named queries and their SQL statements."""
