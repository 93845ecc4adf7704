"""Op logs from tables, files and generators, and the record codec."""
