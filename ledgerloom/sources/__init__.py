"""Reading, mapping and writing of records."""
