"""Net construction and rendering."""
