"""Column functions: row-local expressions that never shuffle."""
