"""Reading and writing of segment tables."""
