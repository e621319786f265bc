"""Reading, parsing and writing."""
