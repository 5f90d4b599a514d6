"""Reading and writing: tables, page text, status snapshots, extraction results."""
