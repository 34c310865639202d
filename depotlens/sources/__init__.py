"""Table declarations, readers, writers and catalog listings."""
